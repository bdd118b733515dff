"""Line dedup with two Bloom filters, for keys seen once and for keys seen twice or more.

A line's key is the line with white space (space, 0x09 to 0x0D) stripped at both ends and A-Z
lower-cased.  Every task fills two filters of a fixed size with the keys of its documents (each key once a
document); merging filters moves to the twice-seen filter whatever two of them have seen once.  Only keys
that the twice-seen filter may hold are shuffled, as rows (key, document), and counted exactly.  A false
positive of the filter costs a row of shuffle and never changes a result; when the corpus outgrows the
filters, more keys are shuffled and the result stays the same.

Null and empty texts are one empty line, whose key is empty and never dropped.  Rows are documents: repeated
rows count as often as they occur.  The columns of the table are kept, an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardflow.llm.common import WHITE, bounded_batches, merged_chunks, stored

#: Bits of a filter, bits set for a key, bits in a chunk of a filter.
FILTER_BITS, PROBES, CHUNK_BITS = 1 << 24, 2, 1 << 19
#: The most dropped keys (16 bytes each) that are broadcast; beyond it they reach their documents by a shuffle.
BROADCAST_KEYS = 500_000


def line_keys(text: bytes | None) -> list[bytes]:
    return [x.strip(WHITE).lower() for x in (text or b"").split(b"\n")]


def _probes(keys: list[bytes], bits: int) -> np.ndarray:
    """The bits of each key, a row for each."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
    return np.stack([(h >> np.uint64(32 * k)) & np.uint64(bits - 1) for k in range(PROBES)], axis=1).astype(np.int64)


def _distinct_keys(column: pa.Array):
    """For each text its distinct keys that aren't empty."""
    for text in column.cast(pa.binary()).to_pylist():
        keys = dict.fromkeys(line_keys(text))
        keys.pop(b"", None)
        yield list(keys)


def _merge(old: bytes, new: bytes) -> bytes:
    (a1, a2), (b1, b2) = (np.frombuffer(x, np.uint8).reshape(2, -1) for x in (old, new))
    return np.stack([a1 | b1, a2 | b2 | (a1 & b1)]).tobytes()


def seen_twice(docs: DataFrame, text: str = "text", bits: int = FILTER_BITS) -> np.ndarray:
    """The twice-seen filter of all documents, as bytes of bits."""
    chunk = min(CHUNK_BITS, bits)

    def fill(batches):
        once, twice = np.zeros(bits, bool), np.zeros(bits, bool)
        for b in batches:
            for keys in _distinct_keys(b.column(0)):
                if keys:
                    # all bits of a key are set together, so a key of a second document finds all its bits set
                    at = _probes(keys, bits)
                    twice[at[once[at].all(axis=1)]] = True
                    once[at] = True
        for k in range(bits // chunk):
            part = slice(k * chunk, (k + 1) * chunk)
            if once[part].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(once[part]).tobytes() + np.packbits(twice[part]).tobytes()], pa.binary())], ["chunk", "values"])

    out = np.zeros(bits // 8, np.uint8)
    for r in merged_chunks(docs.select(text).mapInArrow(fill, "chunk int, values binary"), bits // chunk, _merge).toLocalIterator():
        out[r["chunk"] * chunk // 8 : (r["chunk"] + 1) * chunk // 8] = np.frombuffer(r["values"], np.uint8).reshape(2, -1)[1]
    return out


def key_digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def suspects(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = FILTER_BITS) -> DataFrame:
    """Rows (document, hash of its text, key digest, its first line with the key) of the keys that the twice-seen
    filter may hold."""
    shared = docs.sparkSession.sparkContext.broadcast(seen_twice(docs, text, bits))

    def find(batches):
        seen = shared.value
        for b in batches:
            ids, hashes, digests, first = [], [], [], []
            for i, h, texts in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                keys: dict[bytes, int] = {}
                for n, k in enumerate(line_keys(texts)):
                    keys.setdefault(k, n)
                keys.pop(b"", None)
                if not keys:
                    continue
                listed = list(keys)
                at = _probes(listed, bits)
                for k in np.flatnonzero(((seen[at >> 3] << (at & 7).astype(np.uint8)) & 128 > 0).all(axis=1)):
                    ids.append(i)
                    hashes.append(h)
                    digests.append(key_digest(listed[k]))
                    first.append(keys[listed[k]])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(digests, pa.binary()), pa.array(first, pa.int64())], ["id", "hash", "key", "line"])

    return docs.select(F.col(doc_id).cast("long"), text, F.xxhash64(text)).mapInArrow(find, "id long, hash long, key binary, line long")


def dedup_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, bits: int = FILTER_BITS, broadcast_keys: int = BROADCAST_KEYS
) -> DataFrame:
    """Drop the lines whose key has at least ``min_chars`` code points and is found in ``min_docs`` documents.

    ``text`` becomes what is left, joined by a line feed (null where the text is null and nothing is
    dropped); n_lines, n_dropped are added.  keep_first: the first line of the smallest doc_id with a key
    stays, and further lines of that document with the key go.
    """
    bounded_batches(docs.sparkSession)
    found = stored(suspects(docs, doc_id, text, bits), "line-suspects")
    common = stored(found.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("id", "line")).alias("first")).filter(F.col("n") >= min_docs), "line-common")
    schema = [f for f in docs.schema.fields if f.name.lower() not in ("n_lines", "n_dropped")]
    plain, t = docs.select(*[F.col(f"`{f.name}`") for f in schema]), [f.name for f in schema].index(text)
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def clean(batch: pa.RecordBatch, dropped_of) -> pa.RecordBatch:
        texts, lines, dropped = [], [], []
        for row, s in enumerate(batch.column(t).cast(pa.binary()).to_pylist()):
            keys, drop = line_keys(s), dropped_of(row)
            left, seen = [], {}
            for n, (line, key) in enumerate(zip((s or b"").split(b"\n"), keys, strict=True)):
                if key and (d := seen.get(key)) is None:
                    d = seen[key] = drop.get(key_digest(key), False) if len(key) >= min_chars and (min_chars == 1 or len(key.decode()) >= min_chars) else False
                if not key or d is False or d == n:
                    left.append(line)
            lines.append(len(keys))
            dropped.append(len(keys) - len(left))
            texts.append(s if len(left) == len(keys) else b"\n".join(left))
        columns = [batch.column(k) for k in range(len(schema))]
        columns[t] = pa.array(texts, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*(f.name for f in schema), "n_lines", "n_dropped"])

    out = f"{named}, n_lines long, n_dropped long"
    n_keys = common.count()
    if n_keys <= broadcast_keys:
        rows = {bytes(r["key"]): (r["first"]["id"], r["first"]["line"]) for r in common.toLocalIterator()}
        keys = docs.sparkSession.sparkContext.broadcast(rows)
        at = [f.name for f in schema].index(doc_id)

        def by_broadcast(batches):
            if keep_first:
                for b in batches:
                    ids = b.column(at).to_pylist()
                    yield clean(b, lambda row: _Kept(keys.value, ids[row]))
            else:
                none = _Dropped(keys.value)
                for b in batches:
                    yield clean(b, lambda row: none)

        return plain.mapInArrow(by_broadcast, out)

    # too many keys to broadcast: each row gets the list of its text's dropped keys (as long as its lines).  Equal texts
    # have equal lists; where the hashes of two texts are equal, both get the keys of either, which drops no more lines.
    own = found.select("hash", "key").distinct().join(common, "key").groupBy("hash").agg(F.collect_list(F.struct("key", "first")).alias("_drop"))
    joined = plain.withColumns({"_id": F.col(doc_id).cast("long"), "_hash": F.xxhash64(text)}).join(own.withColumnRenamed("hash", "_text"), F.col("_hash") == F.col("_text"), "left").drop("_hash", "_text")

    def by_join(batches):
        for b in batches:
            ids, lists = b.column(len(schema)).to_pylist(), b.column(len(schema) + 1).to_pylist()

            def dropped_of(row):
                keys = {bytes(x["key"]): (x["first"]["id"], x["first"]["line"]) for x in lists[row] or []}
                return _Kept(keys, ids[row]) if keep_first else _Dropped(keys)

            yield clean(b, dropped_of)

    return joined.mapInArrow(by_join, out)


class _Dropped:
    """-1 (no line stays) for keys that are dropped."""

    def __init__(self, keys):
        self.keys = keys

    def get(self, key, other):
        return -1 if key in self.keys else other


class _Kept(_Dropped):
    """The line that stays in a document, for keys that keep their first line."""

    def __init__(self, keys, doc):
        self.keys, self.doc = keys, doc

    def get(self, key, other):
        first = self.keys.get(key)
        return other if first is None else first[1] if first[0] == self.doc else -1

