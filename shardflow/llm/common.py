"""Helpers shared by the operators: batches, vectorised word hashing, shared folders, dense merges."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and 0x09 to 0x0D.
WHITE = b" \t\n\x0b\x0c\r"
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[list(WHITE)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS = {"n": 0}
#: Bytes of text that are hashed together: their hashes, powers and sums take some 60 times as many.
RUN = 1 << 18


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep the Arrow batches that Python workers get small, so that long texts stay within memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Remove tables that :func:`stored` wrote and that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (splitmix)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS["n"] < n:
        n = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            p = np.full(n, _BASE, np.uint64)
            q = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
            p[0] = q[0] = 1
            _POWERS.update(n=n, p=np.multiply.accumulate(p), q=np.multiply.accumulate(q))
    return _POWERS["p"], _POWERS["q"]


def texts_of(column: pa.Array, size: int = RUN):
    """Yield (first row, bytes, offsets) for runs of rows with about ``size`` bytes; null texts are empty.

    A text is never cut: one longer than ``size`` is a run of its own.
    """
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, size: int = RUN) -> np.ndarray:
    """64-bit hashes of the byte spans ``data[start:end]``, which are in order; works on about ``size`` bytes at a time."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + size, "right")))
        low, s, e = start[i], start[i:j] - start[i], end[i:j] - start[i]
        part = data[low : end[j - 1]]
        p, q = powers(len(part) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTE[part] * p[: len(part)], out=total[1:])
            out[i:j] = mix((total[e] - total[s]) * q[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n bytes from each place on (texts not told apart)."""
    p, q = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * p[: len(data)], out=total[1:])
        return mix((total[n:] - total[:-n]) * q[: max(0, len(data) - n + 1)])


def spans_of(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of bytes of a class (``inside``: a flag for each of 256) in all texts, and
    for each text the range of its runs (n + 1 bounds)."""
    word = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = word[:-1], word[1:]
    start = np.flatnonzero(word & (~before | edge[:-1]))
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and for each text the range of its words (n + 1 bounds)."""
    return spans_of(data, offsets, ~_IS_WHITE)


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return _LOWER[data]


def gathered(batches, column: int, size: int = 1 << 24):
    """Tables of consecutive Arrow batches with about ``size`` bytes in a text column; a batch is never cut."""
    held, total = [], 0
    for b in batches:
        held.append(b)
        total += b.column(column).nbytes
        if total >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, total = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


_RUN_CLASS = np.full(256, 2, np.uint8)  # 0 white space, 1 letters and digits (all bytes of other scripts), 2 marks
_RUN_CLASS[_IS_WHITE] = 0
_RUN_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def run_hashes(data: np.ndarray, offsets: np.ndarray, marks: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of letters and digits (with ``marks`` those of other signs too), A-Z lower-cased, and for
    each text the range of its runs."""
    kind = _RUN_CLASS[data]
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets] = True
    at = np.flatnonzero(change)
    start, end = at[:-1], at[1:]
    use = kind[start] >= 1 if marks else kind[start] == 1
    start, end = start[use], end[use]
    return hash_spans(_LOWER[data], start, end), np.searchsorted(start, offsets)


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, doc_id: str = "doc_id") -> DataFrame:
    """Documents with their label, for at most about ``max_rows`` labelled documents, chosen by a hash of the id.

    The labels of that bounded sample are broadcast; documents are not shuffled.  A document that is labelled
    more than once has its largest label; null labels are left out.
    """
    one = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).alias("_label"))
    n = one.count()
    if n > max_rows:
        one = one.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int((1 << 30) * max_rows / n))
    return docs.join(F.broadcast(one), F.col(doc_id) == F.col("_id")).drop("_id")


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased) of all texts, and for each text the range of its words."""
    start, end, bounds = word_spans(data, offsets)
    return hash_spans(_LOWER[data] if lower else data, start, end), bounds


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, at each word that has n - 1 words after it (texts not told apart)."""
    with np.errstate(over="ignore"):
        out = np.zeros(max(0, len(words) - n + 1), np.uint64)
        for k in range(n):
            out = mix(out * np.uint64(0x2545F4914F6CDD1D) + words[k : k + len(out)] + np.uint64(k + 1))
        return out


def merged_chunks(parts: DataFrame, chunks: int, add) -> DataFrame:
    """Merge partial dense arrays: rows (chunk, values binary) of many tasks become one row a chunk.

    ``add(old, new)`` merges two byte strings and must be associative and commutative.  Each task holds
    only the merged arrays of its own chunks, whatever the number of partial rows.
    """

    def run(batches):
        held: dict[int, bytes] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held[k] = add(held[k], v) if k in held else v
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.binary())], ["chunk", "values"])

    return parts.repartition(min(chunks, 32), "chunk").mapInArrow(run, "chunk int, values binary")


def dense(parts: DataFrame, chunks: int, dtype, add) -> np.ndarray:
    """The merged arrays of all chunks on the driver; their total size is fixed by the caller."""
    rows = merged_chunks(parts, chunks, add).collect()
    by = {r["chunk"]: np.frombuffer(r["values"], dtype) for r in rows}
    empty = np.zeros(len(next(iter(by.values()))), dtype) if by else np.zeros(0, dtype)
    return np.concatenate([by.get(k, empty) for k in range(chunks)]) if by else empty


def add_counts(dtype):
    """The sum of two arrays of counts."""
    return lambda old, new: (np.frombuffer(old, dtype) + np.frombuffer(new, dtype)).tobytes()


#: The most bits of a filter of hashes (16 MB), whatever the number of keys; a fuller one lets more rows through.
FILTER_LIMIT = 1 << 27
#: The most bits of a filter whose parts pass the driver together (4 MB).
FILTER_AT_ONCE = 1 << 25


def hash_filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of a column of 64-bit hashes (bytes of bits): 16 bits a key up to ``FILTER_LIMIT``, three of them
    set inside one block of 512.  A task gets the keys of its part of the filter, so that parts are never merged."""
    (name,) = keys.columns
    bits = min(FILTER_LIMIT, 1 << max(16, (16 * keys.count() - 1).bit_length()))
    chunk = min(bits, 1 << 19)
    lead = (bits // chunk).bit_length() - 1
    part = F.shiftrightunsigned(F.col(name), 64 - lead) if lead else F.lit(0).cast("long")

    def build(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            places = _filter_places(b.column(1).to_numpy().view(np.uint64), bits)
            for k in np.unique(b.column(0).to_numpy()):
                own = places[b.column(0).to_numpy() == k] - k * chunk
                held.setdefault(int(k), np.zeros(chunk, bool))[own.ravel()] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())], ["part", "bits"])

    out = np.zeros(bits // 8, np.uint8)
    placed = keys.select(part.alias("part"), name).repartition(min(32, bits // chunk), "part")
    parts = placed.mapInArrow(build, "part long, bits binary")
    # up to FILTER_AT_ONCE in one job, a larger one by partitions: each of these is a job of its own, also where it is empty
    for r in parts.collect() if bits <= FILTER_AT_ONCE else parts.toLocalIterator():
        out[r["part"] * chunk // 8 : (r["part"] + 1) * chunk // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _filter_places(keys: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each key: three in a block that its leading bits choose."""
    block = keys >> np.uint64(64 - (bits.bit_length() - 1 - 9))
    probes = [(keys >> np.uint64(9 * k)) & np.uint64(511) for k in range(3)]
    return np.stack([block * np.uint64(512) + x for x in probes], axis=1).astype(np.int64)


def in_filter(found: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether a filter may hold each key."""
    at = _filter_places(keys.view(np.uint64) if keys.dtype == np.int64 else keys, 8 * len(found))
    return ((found[at >> 3] << (at & 7).astype(np.uint8)) & 128 > 0).all(axis=1)


def filtered_by(df: DataFrame, column: str, found: np.ndarray, keep: bool = True) -> DataFrame:
    """Rows whose hash the filter may hold, or (not ``keep``) those that it surely hasn't."""
    shared = df.sparkSession.sparkContext.broadcast(found)

    @F.arrow_udf("boolean")
    def held(keys: pa.Array) -> pa.Array:
        return pa.array(in_filter(shared.value, keys.to_numpy()) == keep)

    return df.filter(held(F.col(column)))


def without(df: DataFrame, *names: str) -> DataFrame:
    """The table without the columns of these names, in any case, as Spark tells names apart."""
    lower = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in lower])


def crc_of(doc_id) -> F.Column:
    """crc32 of an id as text."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
