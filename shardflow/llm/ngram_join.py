"""N-gram Jaccard join by a token-group matrix.

A document's set holds the hashes (64 bits) of its distinct n-word shingles, A-Z lower-cased; with fewer words the
whole sequence is one shingle.  Documents link when 100 * intersection >= percent * union.

Equal sets collapse to one representative.  Sets are ordered from rare to frequent shingles (by a table of hashed
counts over all documents, of a fixed size; any order is exact, a good one is fast), and two sets that link share a
shingle of their prefixes, early enough in both.  Representatives are then partitioned into groups: of those that
share a prefix shingle each is checked against the one whose rarest shingle is the most frequent (the one that most
looks like an original), and those that link with it form its group.  The matrix of shingles and groups stores
each group's union of prefix shingles with its extent of sizes and positions.  A query set meets the matrix, the
overlap it can have with any member of a group is bounded, and only groups that qualify are opened, member by
member.  Pairs within a group are never listed, and every pair across groups that can link is checked exactly.

The bound: two sets have at most as many shingles in common as their prefixes have, and one more for each that the
larger has behind its prefix.  What the prefix of a query and the union of a group share is summed over the matrix.
A pair that links does so from the first shingle that both share on, which must come early enough in both: a query meets
a group only at shingles where sizes and positions leave room for that, and sums are made for groups met so.

Null texts and texts without words have empty sets, which link with nothing; rows with a null doc_id have a null
component and link nothing.  Each row links by its own text: rows with one doc_id and different texts may be of
different components.  Representatives are known by a 64-bit hash of their set.  Ties are settled by the smaller hash;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardflow.llm.common import add_counts, bounded_batches, dense, mix, shingle_hashes, stored, texts_of, word_hashes
from shardflow.llm.components import components

COUNT_BITS, CHUNKS = 20, 16
#: Places of the filter of prefix shingles that occur twice, of a fixed size; a full filter only lets more rows pass.
FILTER_BITS = 25
#: The most ids (8 bytes each) that are broadcast to pick texts; beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def sets_of(column: pa.Array, n: int):
    """The sorted distinct shingle hashes of each text."""
    for _, data, offsets in texts_of(column):
        words, bounds = word_hashes(data, offsets)
        shingles = shingle_hashes(words, n)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= n:
                yield np.unique(shingles[a : b - n + 1])
            else:
                yield shingle_hashes(words[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64)


def _counts(docs: DataFrame, text: str, n: int) -> np.ndarray:
    """How many documents have a shingle, by hash place."""

    def run(batches):
        count = np.zeros(1 << COUNT_BITS, np.uint32)
        for b in batches:
            for s in sets_of(b.column(0), n):
                np.add.at(count, (s >> np.uint64(64 - COUNT_BITS)).astype(np.int64), np.uint32(1))
        parts = count.reshape(CHUNKS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["chunk", "values"])

    return dense(docs.select(text).mapInArrow(run, "chunk int, values binary"), CHUNKS, np.uint32, add_counts(np.uint32))


def _key(s: np.ndarray) -> int:
    """The hash of a set, by which it is known."""
    with np.errstate(over="ignore"):
        return int(s.sum().view(np.int64))


def prefixes(docs: DataFrame, n: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """Rows (id, text_hash, n, s1, s2, rank, prefix, often): size, hashes of the whole set, count of its rarest shingle,
    its prefix in order and the counts by which it is ordered."""
    count = _counts(docs, text, n)
    shared = docs.sparkSession.sparkContext.broadcast(count if len(count) else np.zeros(1 << COUNT_BITS, np.uint32))

    def run(batches):
        for b in batches:
            size, h1, h2, rank, heads, counts = [], [], [], [], [], []
            for s in sets_of(b.column(1), n):
                often = shared.value[(s >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
                keep = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                order = np.lexsort((s.view(np.int64), often))[:keep]
                size.append(len(s))
                h1.append(_key(s))
                with np.errstate(over="ignore"):
                    h2.append(int(((s ^ (s >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)).sum().view(np.int64)))
                rank.append(int(often[order[0]]) if keep else 0)
                heads.append(s[order].view(np.int64))
                counts.append(often[order].astype(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in heads])]).astype(np.int32)
            flat, often = (pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (heads, counts))
            lists = [pa.ListArray.from_arrays(pa.array(offsets), x) for x in (flat, often)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(size, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(rank, pa.int64()), *lists], ["id", "text_hash", "n", "s1", "s2", "rank", "prefix", "often"])

    return docs.select(F.col(doc_id).cast("long").alias("id"), text, F.xxhash64(text).alias("text_hash")).mapInArrow(run, "id long, text_hash long, n int, s1 long, s2 long, rank long, prefix array<long>, often array<long>")


def _needed(a: Column, b: Column, percent: int) -> Column:
    """The least intersection of two sets of these sizes that link."""
    return F.ceil(percent * (a + b) / F.lit(100.0 + percent) - 1e-9)


def _repeated(reps: DataFrame) -> DataFrame:
    """Rows (rep, n, rank, pos, token) of prefix shingles that may occur in two prefixes.

    Most occur in one.  Bare shingles are counted first; a Bloom filter of those found twice then keeps the others'
    rows from the wider shuffles.  What it lets pass by chance is counted exactly afterwards.
    """
    twice = reps.select(F.explode("prefix").alias("token")).groupBy("token").count().filter("count > 1").select("token")
    part = (1 << FILTER_BITS) // CHUNKS

    def places(tokens: np.ndarray) -> np.ndarray:
        h = mix(tokens.astype(np.int64).view(np.uint64))
        return np.stack([h >> np.uint64(64 - FILTER_BITS), h & np.uint64((1 << FILTER_BITS) - 1)]).astype(np.int64)

    def fill(batches):
        seen = np.zeros(1 << FILTER_BITS, bool)
        for b in batches:
            seen[places(b.column(0).to_numpy(zero_copy_only=False))] = True
        for k in range(CHUNKS):
            if (own := seen[k * part : (k + 1) * part]).any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], ["chunk", "values"])

    either = lambda old, new: (np.frombuffer(old, np.uint8) | np.frombuffer(new, np.uint8)).tobytes()
    bits = dense(twice.mapInArrow(fill, "chunk int, values binary"), CHUNKS, np.uint8, either)
    shared = reps.sparkSession.sparkContext.broadcast(bits if len(bits) else np.zeros((1 << FILTER_BITS) // 8, np.uint8))

    def keep(batches):
        for b in batches:
            lists = b.column(3)
            tokens = lists.flatten().to_numpy()
            size = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(size)), size)
            pos = np.arange(len(tokens)) - np.repeat(np.cumsum(size) - size, size)
            at = places(tokens)
            hit = np.flatnonzero(((shared.value[at >> 3] << (at & 7).astype(np.uint8)) & 128 > 0).all(axis=0))
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array(row[hit])) for k in range(3)], pa.array(pos[hit], pa.int32()), pa.array(tokens[hit], pa.int64())], ["rep", "n", "rank", "pos", "token"])

    return reps.select("rep", "n", "rank", "prefix").mapInArrow(keep, "rep long, n int, rank long, pos int, token long")


def _only(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose column is in a table of ids, which is broadcast behind a check of its size."""
    ids = stored(ids.toDF("_id").distinct(), "ngram-ids")
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return df.join(few, F.col(column).cast("long") == F.col("_id"), "left_semi")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select("a").union(pairs.select("b"))


def _prefixes_allow(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may link by their whole prefixes.  A shingle of a's prefix that stands no later in the order
    than the end of b's prefix and isn't in that prefix isn't in b at all."""
    heads = _only(reps, "rep", _ends(pairs))
    both = pairs
    for x in "ab":
        both = both.join(heads.select(F.col("rep").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "prefix", "often")]), x)
    both = both.withColumn("c", F.size(F.array_intersect("prefix_a", "prefix_b")))
    most = []
    for x, y in ("ab", "ba"):
        last = f"element_at(often_{y}, -1)", f"element_at(prefix_{y}, -1)"
        early = f"size(filter(arrays_zip(often_{x}, prefix_{x}), z -> z.often_{x} < {last[0]} OR (z.often_{x} = {last[0]} AND z.prefix_{x} <= {last[1]})))"
        most.append(F.col(f"n_{x}") - F.expr(early) + F.col("c"))
    return both.filter(F.least(*most) >= _needed(F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, n: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets link."""
    pairs = stored(_prefixes_allow(stored(pairs, "ngram-candidates"), reps, percent), "ngram-pairs")
    needed = _only(docs, doc_id, _only(reps, "rep", _ends(pairs)).select("id")).select(text)

    def run(batches):
        for b in batches:
            found = [s.view(np.int64) for s in sets_of(b.column(0), n)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in found], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["k", "s"])

    sets = stored(needed.mapInArrow(run, "k long, s array<long>"), "ngram-sets")
    left, right = sets.select(F.col("k").alias("a"), F.col("s").alias("sa")), sets.select(F.col("k").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(right, "b").join(left, "a").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.filter(100 * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, text_hash): the smallest doc_id that is reached by links; xxhash64 of the
    text, which tells rows of one doc_id apart."""
    bounded_batches(docs.sparkSession)
    sets = stored(prefixes(docs, n, percent, doc_id, text), "ngram-prefixes")
    reps = sets.filter("n > 0 AND id IS NOT NULL").groupBy("s1", "s2", "n").agg(F.min(F.struct("id", "rank", "prefix", "often")).alias("r"))
    reps = stored(reps.select("s2", "n", F.col("s1").alias("rep"), "r.id", "r.rank", "r.prefix", "r.often"), "ngram-representatives")
    entries = _repeated(reps)

    # prefix shingles of two or more representatives, with the one that the others are checked against first
    best = F.max(F.struct("rank", F.bitwise_not("rep").alias("order"), "rep", "n", "pos")).alias("pivot")
    shared = entries.groupBy("token").agg(F.count("*").alias("c"), best).filter("c > 1").select("token", F.col("pivot.rep").alias("pivot"), F.col("pivot.n").alias("pn"), F.col("pivot.pos").alias("ppos"))
    entries = stored(entries.drop("rank").join(shared, "token"), "ngram-entries")

    def may_link(n1: str, pos1: str, n2: str, pos2: str) -> Column:
        a, b = F.col(n1), F.col(n2)
        return F.least(a - F.col(pos1), b - F.col(pos2)) >= _needed(a, b, percent)

    stars = entries.filter((F.col("rep") != F.col("pivot")) & may_link("n", "pos", "pn", "ppos")).select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
    links = stored(_verified(stars, reps, docs, n, percent, doc_id, text), "ngram-links")
    group = components(links)

    sizes = group.groupBy("component").agg(F.count("*").alias("gsize"))
    group = group.join(sizes, "component").withColumnRenamed("node", "rep")

    # the matrix: for each prefix shingle the groups that have it
    entries = entries.select("token", "rep", "n", "pos").join(group, "rep", "left")
    entries = stored(entries.select("token", "rep", "n", "pos", F.coalesce("component", "rep").alias("grp"), F.coalesce("gsize", F.lit(1)).alias("gsize")), "ngram-grouped")
    matrix = entries.groupBy("token", "grp").agg(F.max("gsize").alias("gsize"), F.min("n").alias("n_low"), F.max("n").alias("n_high"), F.min("pos").alias("pos_low"))
    several = matrix.groupBy("token").agg(F.count("*").alias("k"), F.max(F.struct("gsize", "grp")).alias("top")).filter("k > 1")
    matrix = stored(matrix.join(several.select("token", "top"), "token"), "ngram-matrix")
    queries = entries.join(matrix.select("token", "grp", "top"), ["token", "grp"]).filter(F.col("grp") != F.col("top.grp"))
    queries = queries.select("token", F.col("rep").alias("q"), F.col("n").alias("qn"), "pos", F.struct("gsize", "grp").alias("own"))

    def enough(c: str, n_low: str, n_high: str) -> Column:
        """Whether a set of qn shingles that shares c of its prefix can link with one of n_low to n_high shingles."""
        qn, share = F.col("qn"), percent / 100.0
        low, high = F.greatest(F.col(n_low), share * qn - 1e-6), F.least(F.col(n_high), qn / share + 1e-6)
        least = [(qn + m) * (share / (1 + share)) - F.greatest(qn, m) * share for m in (low, high)]
        return (low <= high) & (F.col(c) >= F.least(*least) - 1e-6)

    # a query of the smaller group of two meets the larger at each shingle that can be the first that it shares with a
    # member, and opens it if what both share can be enough
    fits = (100 * F.col("n_high") >= percent * F.col("qn")) & (100 * F.col("qn") >= percent * F.col("n_low"))
    smallest = F.greatest(F.col("n_low"), F.ceil(percent * F.col("qn") / F.lit(100.0) - 1e-6))
    first = F.least(F.col("qn") - F.col("pos"), F.col("n_high") - F.col("pos_low")) >= _needed(F.col("qn"), smallest, percent)
    groups = matrix.drop("top").withColumnsRenamed({"token": "t", "grp": "g"})
    met = queries.join(groups, (F.col("token") == F.col("t")) & (F.col("own") < F.struct("gsize", "g")) & fits & first)
    met = stored(met.select("q", "qn", "token", "pos", F.col("g").alias("grp")), "ngram-met")
    shares = met.select(F.col("q").alias("k"), F.col("grp").alias("with")).distinct().join(queries, F.col("k") == F.col("q"))
    shares = shares.join(groups, (F.col("token") == F.col("t")) & (F.col("with") == F.col("g")) & fits)
    shares = shares.groupBy("q", "qn", "g").agg(F.count("*").alias("c"), F.min("n_low").alias("n_low"), F.max("n_high").alias("n_high"))
    qualify = stored(shares.filter(enough("c", "n_low", "n_high")).select("q", F.col("g").alias("grp")), "ngram-qualify")
    members = entries.select(F.col("token").alias("t"), F.col("grp").alias("g"), "rep", "n", F.col("pos").alias("at"))
    opened = met.join(qualify, ["q", "grp"], "left_semi").join(members, (F.col("token") == F.col("t")) & (F.col("grp") == F.col("g")) & may_link("qn", "pos", "n", "at"))
    more = _verified(opened.select(F.col("q").alias("a"), F.col("rep").alias("b")).distinct(), reps, docs, n, percent, doc_id, text)

    linked = components(links.union(more)).withColumnRenamed("node", "rep")
    named = reps.select(F.col("rep").alias("s1"), "s2", "n", "id", "rep").join(linked, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = stored(named.join(least, "component").select("s1", "s2", "n", "component_id"), "ngram-components")
    out = sets.select("id", "text_hash", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id")
    return out.select(F.col("id").alias(doc_id), F.col("n").cast("long").alias("n_shingles"), component, "text_hash")
