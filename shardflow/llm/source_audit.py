"""Source divergence audit: which sources of a language use words unlike the language's, or unlike each other.

Terms are the longest runs of ASCII letters and of bytes from 0x80 on, A-Z lower-cased.  A language keeps the terms
that ``min_docs`` of its documents have.  With smoothed probabilities p in parts of 10^9, the divergence of a term
between two distributions is f = floor((p - q)^2 / (p + q)).

Counting: every task counts the terms of about ``CHUNK`` bytes of text at a time, a row for each language and term with
the counts of all its sources; rows meet by (language, term), so that a key has at most a row for each chunk, and become
postings: a kept term with its count in each source.

Terms (top k of a group by f, where the group's p is above the language's q): f grows with p and falls with q, so the
terms of a group whose counts fall into one bucket have f of at most f(p of the largest count, q of the least language
count).  Buckets are opened best bound first, over all groups at once and twice as many in each round; a group is done
when no bucket that is still closed has a bound as high as its k-th value (strictly below ends it, so ties are found).

Pairs (all sources of a language against each other): the value that a pair would have if no term were in both sources
needs only how often each count occurs in each source.  Terms in both correct it: tasks take postings in bounded
pieces, evaluate every pair of sources in a posting and add up by pair before anything moves.

Null text, language and source are empty strings; groups without terms are compared too.  Repeated rows count as often
as they occur, ties go by ascending UTF-8 of the item.  Other columns are ignored; an empty table gives an empty table.
Terms are told apart by 64-bit hashes inside a chunk, and by their text everywhere else.  Counts of a group may reach
9 * 10^18 / 10^9 without loss, beyond that decimals hold the products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardflow.llm.common import bounded_batches, gathered, hash_spans, lowered, spans_of, stored, texts_of

#: Bytes of text that are counted together, pairs of postings that are evaluated together.
CHUNK, PAIRS = 1 << 24, 1 << 21
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_COUNTS = "lang string, term string, source array<string>, n array<bigint>, docs array<bigint>"


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """A number for each row's value, and the values; null is the empty string."""
    found = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).fill_null("").dictionary_encode()
    if isinstance(found, pa.ChunkedArray):
        found = found.combine_chunks()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def _lists(values: pa.Array, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values)


def _counted(table: pa.Table) -> pa.RecordBatch | None:
    """The rows of ``_COUNTS`` of some documents (text, lang, source)."""
    lang, langs = _codes(table.column(1))
    source, sources = _codes(table.column(2))
    hashes, rows, at, texts = [], [], [], []
    base = 0
    for first, data, offsets in texts_of(pa.concat_arrays(table.column(0).chunks)):
        start, end, bounds = spans_of(data, offsets, _LETTER)
        low = lowered(data)
        hashes.append(hash_spans(low, start, end))
        rows.append(np.repeat(np.arange(first, first + len(bounds) - 1), np.diff(bounds)))
        at.append(np.stack([start, end]) + base)
        texts.append(low)
        base += len(low)
    if not hashes or not sum(map(len, hashes)):
        return None
    rows, at, data = np.concatenate(rows), np.concatenate(at, axis=1), np.concatenate(texts)
    _, where, term = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    key, n = np.unique(term * table.num_rows + rows, return_counts=True)  # (term, document)
    term, row = np.divmod(key, table.num_rows)
    n_groups = len(langs) * len(sources)
    key, back = np.unique(term * n_groups + lang[row] * len(sources) + source[row], return_inverse=True)
    term, group = np.divmod(key, n_groups)
    counts, docs = (np.bincount(back, weights=w, minlength=len(key)).astype(np.int64) for w in (n, None))
    of, by = np.divmod(group, len(sources))
    head = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (of[1:] != of[:-1])]))
    start, end = at[:, where[term[head]]]
    length = end - start
    ends = np.cumsum(length)
    spelled = data[np.repeat(start - (ends - length), length) + np.arange(ends[-1])]
    terms = pa.Array.from_buffers(pa.large_binary(), len(head), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(spelled)])
    columns = [langs.take(pa.array(of[head])), terms.cast(pa.binary()).cast(pa.string()), _lists(sources.take(pa.array(by)), head), _lists(pa.array(counts), head), _lists(pa.array(docs), head)]
    return pa.RecordBatch.from_arrays(columns, ["lang", "term", "source", "n", "docs"])


def term_postings(docs: DataFrame, text: str, lang: str, source: str, min_docs: int) -> DataFrame:
    """Rows (lang, term, total, entries): kept terms, their count in the language and in each source that has them."""
    bounded_batches(docs.sparkSession)

    def count(batches):
        for table in gathered(batches, 0, CHUNK):
            found = _counted(table)
            if found is not None:
                for k in range(0, found.num_rows, 20_000):
                    yield found.slice(k, 20_000)

    counted = docs.select(F.col(text), F.col(lang).cast("string"), F.col(source).cast("string")).mapInArrow(count, _COUNTS)
    # rows meet by (lang, term); what follows groups within that partitioning
    met = counted.repartition("lang", "term").select("lang", "term", F.explode(F.arrays_zip("source", "n", "docs")).alias("x"))
    by_source = met.groupBy("lang", "term", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("n"), F.sum("x.docs").alias("docs"))
    by_term = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("entries"))
    return by_term.filter(F.col("docs") >= min_docs).drop("docs")


def _p(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (n + 2 v)), exact."""
    parts = F.lit(1_000_000_000).cast("decimal(18,0)") * (count + 2).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", parts, (n + 2 * v).cast("decimal(20,0)"))


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _groups(docs: DataFrame, postings: DataFrame, lang: str, source: str) -> DataFrame:
    """Rows (lang, source, v, n, n_lang, zero) of every occurring group: the language's kept terms, the counts of the
    group and of the language, and the group's probability of a term that it doesn't have."""
    occurring = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).distinct()
    of_lang = postings.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    of_group = postings.select("lang", F.explode("entries").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("n"))
    found = occurring.join(of_lang, "lang", "left").join(of_group, ["lang", "source"], "left").fillna(0, ["v", "n", "n_lang"])
    return stored(found.withColumn("zero", F.when(F.col("v") > 0, _p(F.lit(0).cast("long"), F.col("n"), F.col("v"))).otherwise(F.lit(1).cast("long"))), "audit-groups")


def _bucket(n: Column) -> Column:
    """A count's bucket: counts up to 15 by themselves, larger ones by eighths of an octave."""
    return F.when(n < 16, n).otherwise(F.floor(8 * F.log2(n))).cast("int")


def top_terms(postings: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """Rows (lang, source, item, value, rank) of the k terms of each group with the highest f among those with p > q."""
    each = postings.select("lang", "term", "total", F.explode("entries").alias("x")).select("lang", "x.source", "term", "total", F.col("x.n").alias("n"))
    each = each.withColumn("bucket", _bucket(F.col("n")))
    sizes = groups.select("lang", "source", "v", F.col("n").alias("n_group"), "n_lang")
    p, q = _p(F.col("n"), F.col("n_group"), F.col("v")), _p(F.col("total"), F.col("n_lang"), F.col("v"))
    bounds = each.groupBy("lang", "source", "bucket").agg(F.max("n").alias("n"), F.min("total").alias("total")).join(sizes, ["lang", "source"])
    bounds = bounds.withColumns({"p": p, "q": q}).filter("p > q").withColumn("bound", _f(F.col("p"), F.col("q")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket")  # a row for each bucket: some hundred
    bounds = stored(bounds.withColumn("place", F.row_number().over(order)).select("lang", "source", "bucket", "bound", "place"), "audit-bounds")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    done, reach, tops, active = 0, 4, None, bounds.select("lang", "source").distinct()
    while True:
        opened = bounds.filter((F.col("place") > done) & (F.col("place") <= reach)).join(active, ["lang", "source"], "left_semi").select("lang", "source", "bucket")
        values = each.join(opened, ["lang", "source", "bucket"]).join(sizes, ["lang", "source"]).withColumns({"p": p, "q": q}).filter("p > q")
        values = values.select("lang", "source", F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
        merged = values if tops is None else values.union(tops.select("lang", "source", "item", "value"))
        tops = stored(merged.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "audit-terms")
        kth = tops.filter(F.col("rank") == k).select("lang", "source", F.col("value").alias("kth"))
        ahead = bounds.filter(F.col("place") > reach).join(kth, ["lang", "source"], "left").filter(F.col("kth").isNull() | (F.col("bound") >= F.col("kth")))
        active = stored(ahead.select("lang", "source").distinct(), "audit-active")
        if active.isEmpty():
            return tops
        done, reach = reach, 2 * reach


def _both(batches):
    """Rows (lang, a, b, more) of postings (lang, sources, p, zero): what the terms that both sources have add to f."""
    for batch in batches:
        lang, langs = _codes(batch.column(0))
        entries = batch.column(1)
        offsets = entries.offsets.to_numpy().astype(np.int64)
        flat = entries.values
        source, sources = _codes(flat.field(0))
        p, zero = (flat.field(c).to_numpy(zero_copy_only=False) for c in (1, 2))
        row = 0
        size = np.diff(offsets)
        while row < len(size):
            stop = max(row + 1, int(np.searchsorted(np.cumsum(size[row:] ** 2), PAIRS, "right")) + row)
            # each entry of a posting is met with all entries of it, in pieces: a long posting is cut by its first entries
            first = np.arange(offsets[row], offsets[stop])
            of = np.repeat(np.arange(row, stop), size[row:stop])
            for k in range(0, len(first), step := max(1, PAIRS // max(1, int(size[row:stop].max(initial=1))))):
                a, at = first[k : k + step], of[k : k + step]
                n = size[at]
                left = np.repeat(a, n)
                right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[at], n)
                use = source[left] != source[right]
                left, right, by = left[use], right[use], lang[np.repeat(at, n)[use]]
                f = lambda x, y: (x - y) * (x - y) // (x + y)
                more = f(p[left], p[right]) - f(p[left], zero[right]) - f(zero[left], p[right]) + f(zero[left], zero[right])
                key, back = np.unique((by * len(sources) + source[left]) * len(sources) + source[right], return_inverse=True)
                total = np.zeros(len(key), np.int64)
                np.add.at(total, back, more)
                rest, b = np.divmod(key, max(1, len(sources)))
                of_lang, first_source = np.divmod(rest, max(1, len(sources)))
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(of_lang)), sources.take(pa.array(first_source)), sources.take(pa.array(b)), pa.array(total)], ["lang", "source", "item", "value"])
            row = stop


def source_pairs(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (lang, source, item, value) for every two sources of a language: f summed over all kept terms."""
    other = groups.select(F.col("lang").alias("_lang"), F.col("source").alias("item"), F.col("zero").alias("zero2"))
    pairs = groups.join(other, (F.col("lang") == F.col("_lang")) & (F.col("source") != F.col("item"))).select("lang", "source", "item", "v", "zero", "zero2")
    base = pairs.select("lang", "source", "item", F.when(F.col("v") > 0, F.col("v") * _f(F.col("zero"), F.col("zero2"))).otherwise(0).alias("value"))
    each = postings.select("lang", "term", F.explode("entries").alias("x")).select("lang", "term", "x.source", "x.n")
    sizes = groups.select("lang", "source", "v", F.col("n").alias("n_group"), "zero")
    # a group's own terms against a source that has none of them, by count
    often = each.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")).join(sizes, ["lang", "source"])
    often = often.select("lang", "source", "terms", "zero", _p(F.col("n"), F.col("n_group"), F.col("v")).alias("p"))
    alone = often.join(other, (F.col("lang") == F.col("_lang")) & (F.col("source") != F.col("item")))
    alone = alone.groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * (_f(F.col("p"), F.col("zero2")) - _f(F.col("zero"), F.col("zero2")))).alias("value"))
    swapped = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    known = each.join(sizes, ["lang", "source"]).select("lang", "term", "source", _p(F.col("n"), F.col("n_group"), F.col("v")).alias("p"), "zero")
    met = known.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "zero")).alias("entries"))  # at most the language's sources
    both = met.filter(F.size("entries") > 1).select("lang", "entries").mapInArrow(_both, "lang string, source string, item string, value long")
    return base.union(alone).union(swapped).union(both).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))


def audit_sources(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 10, k: int = 10) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): part ``pair`` has all other sources of the language by their
    divergence, part ``term`` the k terms that the source overuses most against its language."""
    postings = stored(term_postings(docs, text, lang, source, min_docs), "audit-postings")
    groups = _groups(docs, postings, lang, source)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = source_pairs(postings, groups).withColumn("rank", F.row_number().over(order))
    parts = [df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, df in (("pair", pairs), ("term", top_terms(postings, groups, k)))]
    return parts[0].union(parts[1])
