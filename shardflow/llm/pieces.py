"""SentencePiece encoding and decoding over a relational lattice.

A text (a space in front, spaces as U+2581) is cut between any two characters that stand beside each other in no
piece: no piece reaches across, so what stands between cuts, a word, is encoded by itself.  The substrings of bounded
length of each word are exploded and joined with the piece table, the edges are grouped by word, and a fold with
Spark's higher-order ``aggregate`` runs over each word's lattice.

The fold depends on the kind of model, which the model file says.  For a unigram model it is Viterbi: the best score
of each place from the edges that end there.  For a BPE model the best sum of scores is not what the model encodes
(its scores are ranks of merges), so there the fold replays the merges: a piece can only come about by the merge that
makes it when it is encoded by itself, and where every piece's own merges come in the order of their ranks (checked
when the table is made) one pass over a word's edges, by rank and then from left to right, applies each edge whose two
parts stand there.  That gives exactly the library's ids; Viterbi does not.  Characters without a piece become their
bytes' pieces (or one unknown id each).

Words seen most (at most ``FREQUENT`` of them, a fixed bound; a cache that changes no result) are encoded once and
broadcast with their ids.  Each row becomes the numbers of its frequent words, compressed, with holes for its other
words; rows move once, in that form, and their other words are encoded where they arrive.  Words are told apart by 64-bit
hashes.  ``spark.sql.objectHashAggregate.sortBased.fallbackThreshold`` of the session is raised, so that words are grouped
without a sort where a task has few.

Null and empty texts have no ids.  A literal U+2581 in a text is decoded as a space, as the library does.  Repeated
rows are encoded alike, other columns are kept (``ids`` is replaced), an empty table gives an empty table.  A word may
have any length; a run of a million characters without a cut makes one slow row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardflow.llm.common import bounded_batches, mix, powers, stored, without

SPACE = "▁"
FREQUENT = 1 << 19
#: Words of these that are hashed at a time.
HASHED = 1 << 14
#: Characters that are looked at together, and those whose words a task gets; the most tasks; the most words grouped without a sort.
RUN, TASK_CHARS, TASKS, GROUPS = 1 << 18, 1 << 21, 20_000, 100_000
#: Hashes and counts that a task keeps before it adds them up; words that it keeps.
KEPT, NAMED = 1 << 20, 1 << 18
#: The longest word whose boundaries are the bits of one number; the flag of ids that are characters without a piece.
BITS, UNKNOWN = 61, 1 << 27


@dataclass(frozen=True)
class Pieces:
    """A piece table: text, id, score of the normal pieces; first byte piece (-1: none) and unknown id."""

    rows: tuple
    bytes_at: int
    unknown: int
    bpe: bool

    @cached_property
    def longest(self) -> int:
        return max((len(p) for p, _, _ in self.rows), default=1)

    @cached_property
    def neighbours(self) -> set[tuple[str, str]]:
        """Characters that stand beside each other in a piece."""
        return {ab for p, _, _ in self.rows for ab in zip(p, p[1:], strict=False)}

    def merges(self) -> dict[str, tuple[int, int]]:
        """For each piece that merges can make: its rank (that of its score) and the length of its left part."""
        rank = {s: k for k, s in enumerate(sorted({s for _, _, s in self.rows}, reverse=True))}
        ranks = {p: rank[s] for p, _, s in self.rows}
        out = {}
        for piece in ranks:
            parts, last = list(piece), None
            while len(parts) > 1:
                found = [(ranks[ab], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (ab := a + b) in ranks]
                if not found:
                    break
                r, i = min(found)
                if last is not None and r < last[0]:
                    raise ValueError(f"the merges of {piece!r} don't come in the order of their ranks")
                last = r, sum(map(len, parts[: i + 1]))
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(parts) == 1 and last:
                out[piece] = last
        return out


def _is_bpe(proto: bytes) -> bool:
    """The kind of model: field 3 (2 is BPE; 1, the default, is unigram) of field 2 of the model's message."""

    def fields(data: bytes):
        at = 0

        def number() -> int:
            nonlocal at
            n = shift = 0
            while True:
                n |= (data[at] & 127) << shift
                at, shift = at + 1, shift + 7
                if data[at - 1] < 128:
                    return n

        while at < len(data):
            tag = number()
            if tag & 7 == 0:
                yield tag >> 3, number()
            else:
                size = {1: 8, 5: 4}.get(tag & 7) or number()
                yield tag >> 3, data[at : at + size]
                at += size

    kinds = [v for k, spec in fields(proto) if k == 2 for j, v in fields(spec) if j == 3]
    if any(k not in (1, 2) for k in kinds):
        raise ValueError("only BPE and unigram models can be encoded")
    return 2 in kinds


def load_pieces(path: str) -> Pieces:
    """The piece table of a SentencePiece model file, which is read here and nowhere else."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = range(m.get_piece_size())
    rows = tuple((m.id_to_piece(i), i, float(m.get_score(i))) for i in n if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)))
    return Pieces(rows, next((i for i in n if m.is_byte(i)), -1), m.unk_id(), _is_bpe(m.serialized_model_proto()))


def _hashes(chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    p, q = powers(len(chars) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum((chars * np.uint64(0xD6E8FEB86659FD93) + np.uint64(12345677)) * p[: len(chars)], out=total[1:])
        return mix((total[end] - total[start]) * q[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Cutter:
    """Cuts texts into words."""

    def __init__(self, neighbours: set[tuple[str, str]]):
        self.left, self.right = np.zeros(0x110000, np.uint16), np.zeros(0x110000, np.uint16)
        for side, k in ((self.left, 0), (self.right, 1)):
            for n, c in enumerate(sorted({ab[k] for ab in neighbours}), 1):
                side[ord(c)] = n
        self.width = int(self.right.max()) + 1
        self.joined = np.zeros((int(self.left.max()) + 1) * self.width, bool)
        for a, b in neighbours:
            self.joined[int(self.left[ord(a)]) * self.width + int(self.right[ord(b)])] = True

    def words(self, texts: list[str | None]):
        """Yield, for runs of texts, (first row, all their characters, start and end of each word, hash of each word,
        the range of each text's words)."""
        texts = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        i = 0
        while i < len(texts):
            j, n = i + 1, len(texts[i])
            while j < len(texts) and n + len(texts[j]) <= RUN:
                n, j = n + len(texts[j]), j + 1
            whole = "".join(texts[i:j])
            u = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
            texts_at = np.concatenate([[0], np.cumsum([len(t) for t in texts[i:j]])]).astype(np.int64)
            cut = np.ones(len(u) + 1, bool)
            if len(u):
                cut[1:-1] = ~self.joined[self.left[u[:-1]].astype(np.int32) * self.width + self.right[u[1:]]]
            cut[texts_at] = True
            at = np.flatnonzero(cut)
            start, end = at[:-1], at[1:]
            yield i, whole, start, end, _hashes(u, start, end), np.searchsorted(start, texts_at)
            i = j


def _often(docs: DataFrame, text: str, pieces: Pieces) -> DataFrame:
    """Rows (w, n): words that a task sees twice or more, and how often; and one of a null word with the number of
    characters of all texts, for each task."""
    neighbours = pieces.neighbours

    def run(batches):
        cutter, words, chars = Cutter(neighbours), Repeated(), 0
        for b in batches:
            for _, whole, start, end, h, _ in cutter.words(b.column(0).to_pylist()):
                chars += len(whole)
                words.add(whole, start, end, h)
            if words.full():
                yield pa.RecordBatch.from_arrays(words.taken(), ["w", "n"])
        yield pa.RecordBatch.from_arrays(words.taken(), ["w", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([chars], pa.int64())], ["w", "n"])

    return docs.select(text).mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))


class Repeated:
    """Counts of words by their hashes, over many runs of texts; a word is kept as text from its second time on."""

    def __init__(self):
        self.seen, self.texts, self.runs, self.rows = np.zeros(1 << 22, bool), {}, [], 0

    def add(self, whole: str, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> None:
        h, first, n = np.unique(h, return_index=True, return_counts=True)
        place = (h >> np.uint64(42)).astype(np.int64)
        again = (n > 1) | self.seen[place]  # some are seen for the first time, at the place of another
        self.seen[place] = True
        for x, a, z in zip(h[again].tolist(), start[first[again]].tolist(), end[first[again]].tolist(), strict=True):
            if x not in self.texts:
                self.texts[x] = whole[a:z]
        self.runs.append((h, n))
        self.rows += len(h)

    def full(self) -> bool:
        return self.rows > KEPT or len(self.texts) > NAMED

    def taken(self) -> list[pa.Array]:
        """Words seen twice or more and their counts so far, from which it starts anew."""
        h, n = (np.concatenate([np.zeros(0, t), *(x[k] for x in self.runs)]) for k, t in enumerate((np.uint64, np.int64)))
        h, of = np.unique(h, return_inverse=True)
        n = np.bincount(of, n, len(h)).astype(np.int64)[np.searchsorted(h, np.fromiter(self.texts, np.uint64, len(self.texts)))]
        words = pa.array(list(self.texts.values()), pa.string()).filter(pa.array(n > 1))
        self.__init__()
        return [words, pa.array(n[n > 1])]


def _edges(words: DataFrame, pieces: Pieces, keys: list[str]) -> DataFrame:
    """The lattice's edges: every substring of each word ``w`` that is a piece, and each character, with the keys of its
    word; the word's other columns go with its first edge only.  Rows don't move."""
    table = pd.DataFrame(list(pieces.rows), columns=["piece", "id", "score"])
    merges = pieces.merges() if pieces.bpe else {}
    table["merge"] = [((m[0] << 44) | (len(p) << 8) | m[1]) if (m := merges.get(p)) else -1 for p in table["piece"]]
    table = words.sparkSession.createDataFrame(table, "piece string, id int, score double, merge long")
    other = words.columns
    # a position at a time, then a length at a time
    cells = words.select(*other, F.length("w").alias("size"), F.explode(F.expr("sequence(0, length(w) - 1)")).alias("s"))
    cells = cells.withColumn("head", F.expr(f"substring(w, s + 1, {pieces.longest})"))
    cells = cells.select(*other, "size", "s", "head", F.explode(F.expr("sequence(1, length(head))")).alias("l"))
    once = [F.when((F.col("s") == 0) & (F.col("l") == 1), F.col(c)).alias(c) for c in [*other, "size"] if c not in keys]
    cells = cells.select(*keys, *once, "s", "l", F.expr("substring(head, 1, l)").alias("piece"))
    return cells.join(F.broadcast(table), "piece", "left").filter("id IS NOT NULL OR l = 1")  # as many rows as the model has pieces


def _merged(long: bool) -> str:
    """The ids of a word by its merges.  ``merges`` are edges in order: rank, start, length, length of the left part;
    ``units`` are start, length and id.  A bit for each place of the word says whether a symbol begins there: bits of one
    number, or, for long words, of one number for every 32 places."""
    if long:
        bits = "transform(sequence(0, size div 32 + 2), i -> 4294967295L)"
        window = lambda s: f"shiftright(element_at(b, CAST({s} div 32 AS INT) + 1) | shiftleft(element_at(b, CAST({s} div 32 AS INT) + 2), 32), {s} % 32)"
        place = "CAST({0} div 32 AS INT)"
        clear = f"concat(slice(b, 1, {place}), array(element_at(b, {place} + 1) & ~shiftleft(1L, {{0}} % 32)), slice(b, {place} + 2, size(b)))"
    else:
        bits = "shiftleft(1L, size + 1) - 1L"
        window, clear = (lambda s: f"shiftright(b, {s})"), "b & ~shiftleft(1L, {0})"
    s, l, m = "CAST(shiftright(x, 16) & 268435455 AS INT)", "CAST(shiftright(x, 8) & 255 AS INT)", "CAST(x & 255 AS INT)"
    fold = f"""aggregate(merges, {bits}, (b, x) -> CASE WHEN ({window(s)} & (shiftleft(2L, {l}) - 1L)) = (1L + shiftleft(1L, {m}) + shiftleft(1L, {l}))
        THEN {clear.format(f"({s} + {m})")} ELSE b END)"""
    s, l = "CAST(shiftright(u, 36) AS INT)", "CAST(shiftright(u, 28) & 255 AS INT)"
    symbols = f"filter(units, u -> ({window(s)} & (shiftleft(2L, {l}) - 1L)) = (1L + shiftleft(1L, {l})))"
    return f"transform(array({fold}), b -> transform(sort_array({symbols}), u -> CAST(u & 268435455L AS INT)))[0]"  # the array binds b


def _best() -> str:
    """The ids of a word by Viterbi: the best (cost, start, id) of each place in turn, then back from the end."""
    step = "array_min(transform(filter(edges, x -> x.s + x.l = k), x -> struct(a[x.s].cost + x.cost AS cost, x.s AS s, x.id AS id)))"
    back = """aggregate(sequence(1, size), named_struct('at', size, 'ids', CAST(array() AS array<int>)), (t, k) ->
        CASE WHEN t.at = 0 THEN t ELSE named_struct('at', a[t.at].s, 'ids', concat(array(a[t.at].id), t.ids)) END, t -> t.ids)"""
    return f"aggregate(sequence(1, size), array(named_struct('cost', 0D, 's', 0, 'id', -1)), (a, k) -> concat(a, array({step})), a -> {back})"


def _folded(words: DataFrame, pieces: Pieces, keys: list[str], others: list[str]) -> DataFrame:
    """Rows (keys, others, ids) of words, which are dealt out by their keys: edges grouped by word, and the fold."""
    unit = F.coalesce("id", F.lit(UNKNOWN) + F.ascii("piece"))
    if pieces.bpe:
        merge = F.when(F.col("merge") >= 0, F.col("merge") + F.shiftleft(F.col("s").cast("long"), 16))
        unit = F.shiftleft(F.col("s").cast("long"), 36) + F.shiftleft(F.col("l").cast("long"), 28) + unit
        edges = [F.sort_array(F.collect_list(merge)).alias("merges"), F.collect_list(unit).alias("units")]
        ids = f"CASE WHEN size <= {BITS} THEN {_merged(False)} ELSE {_merged(True)} END"
    else:
        worst = 10.0 - min((s for _, _, s in pieces.rows), default=0.0)
        edges = [F.collect_list(F.struct(F.coalesce(-F.col("score"), F.lit(worst)).alias("cost"), "s", "l", unit.alias("id"))).alias("edges")]
        ids = _best()
    once = [F.first(c, ignorenulls=True).alias(c) for c in ["size", *others]]
    grouped = _edges(words, pieces, keys).groupBy(*keys).agg(*once, *edges)
    grouped = grouped.withColumn("ids", F.expr(ids))
    c, at = f"(i - {UNKNOWN})", pieces.bytes_at
    tail = lambda n: f"{at} + 128 + (shiftright({c}, {n}) & 63)"
    known = f"""CASE WHEN i < {UNKNOWN} THEN array(i) WHEN {at} < 0 THEN array({pieces.unknown}) WHEN {c} < 128 THEN array({at} + {c})
        WHEN {c} < 2048 THEN array({at} + 192 + shiftright({c}, 6), {tail(0)}) WHEN {c} < 65536 THEN array({at} + 224 + shiftright({c}, 12), {tail(6)}, {tail(0)})
        ELSE array({at} + 240 + shiftright({c}, 18), {tail(12)}, {tail(6)}, {tail(0)}) END"""
    # the array binds the ids, which would else be computed again
    all_known = f"transform(array(ids), v -> CASE WHEN exists(v, i -> i >= {UNKNOWN}) THEN flatten(transform(v, i -> {known})) ELSE v END)[0]"
    return grouped.withColumn("ids", F.expr(all_known)).drop("size", "merges", "units", "edges")


def encode_words(words: DataFrame, pieces: Pieces, tasks: int | None = None) -> DataFrame:
    """Rows (w, n, ids) of a table of distinct words (w, n)."""
    words = words.repartition(tasks, "w") if tasks else words.repartition("w")
    return _folded(words, pieces, ["w"], ["n"])


def _bin():
    return F.floor(F.log2("n") * 8)


def _frequent(words: DataFrame) -> DataFrame:
    """The words of the highest bins of counts, at most FREQUENT."""
    bins = {r["k"]: r["count"] for r in words.groupBy(_bin().alias("k")).count().collect()}
    least, total = max(bins, default=0) + 1, 0
    for k in sorted(bins, reverse=True):
        total += bins[k]
        if total > FREQUENT:
            break
        least = k
    return words.filter(_bin() >= least)


class Frequent:
    """Words by number, the most frequent first: their hashes and ids, and a table to find a hash."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([("n", "descending"), ("w", "ascending")])
        ids = pa.concat_arrays(rows["ids"].chunks) if rows.num_rows else pa.array([], pa.list_(pa.int32()))
        self.at = ids.offsets.to_numpy().astype(np.int32)
        self.ids = ids.flatten().to_numpy().astype(np.int32)
        # some thousand words at a time: the driver makes this table, and hashes take some 60 bytes a character
        h = np.zeros(rows.num_rows, np.uint64)
        for k in range(0, rows.num_rows, HASHED):
            words = rows["w"].slice(k, HASHED).to_pylist()
            end = np.cumsum([len(w) for w in words])
            h[k : k + HASHED] = _hashes(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.append(0, end[:-1]), end)
        order = np.argsort(h, kind="stable")
        self.hashes, self.numbers = h[order], order.astype(np.int32)
        self.places = np.searchsorted(self.hashes, np.arange((1 << 18) + 1, dtype=np.uint64) << np.uint64(46)).astype(np.int32) if len(h) else np.zeros((1 << 18) + 1, np.int32)
        self.places[-1] = len(h)
        self.most = int(np.diff(self.places).max())

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each word, -1 of those that aren't here."""
        place = (h >> np.uint64(46)).astype(np.int64)
        at, end = self.places[place], self.places[place + 1]
        out, left = np.full(len(h), -1, np.int32), np.flatnonzero(at < end)
        for k in range(self.most):
            left = left[at[left] + k < end[left]]
            spot = at[left] + k
            hit = self.hashes[spot] == h[left]
            out[left[hit]] = self.numbers[spot[hit]]
            left = left[~hit]
        return out


def _coded(shared, neighbours, at: int, names: list[str]):
    """Rows with ``_coded`` (numbers of words from 1 on, 0 is a hole; a plane for each of three bytes), ``_holes`` (which of
    ``_words`` is in each hole) and ``_words`` (one at least)."""

    def run(batches):
        cutter, frequent, squeeze = Cutter(neighbours), shared.value, zstandard.ZstdCompressor(1)
        for b in batches:
            coded, holes, others = [], [], []
            for _, whole, start, end, h, bounds in cutter.words(b.column(at).to_pylist()):
                number = (frequent.find(h) + 1).astype("<u4")
                planes = np.ascontiguousarray(number.view(np.uint8).reshape(-1, 4).T[:3])
                rare = np.flatnonzero(number == 0)
                ends = np.searchsorted(rare, bounds)
                hashes, start, end, rare = h[rare].tolist(), start[rare].tolist(), end[rare].tolist(), None
                for k in range(len(bounds) - 1):
                    coded.append(squeeze.compress(planes[:, bounds[k] : bounds[k + 1]].tobytes()))
                    own: dict[int, int] = {}
                    words, which = [], []
                    for i in range(ends[k], ends[k + 1]):
                        if (n := own.setdefault(hashes[i], len(own))) == len(words):
                            words.append(whole[start[i] : end[i]])
                        which.append(n)
                    holes.append(which)
                    others.append(words or [SPACE])
            kept = [c for k, c in enumerate(b.columns) if names[k] is not None]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(coded, pa.binary()), pa.array(holes, pa.list_(pa.int32())), pa.array(others, pa.list_(pa.string()))], [*(n for n in names if n is not None), "_coded", "_holes", "_words"]
            )

    return run


def _spread(values: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``which`` of a list array one after the other, and their sizes."""
    size = offsets[which + 1] - offsets[which]
    skip = np.cumsum(size) - size
    return values[np.repeat(offsets[which] - skip, size) + np.arange(size.sum())], size


def _filled(shared, kept: int, names: list[str]):
    """Rows with the ids of all their words."""

    def run(batches):
        frequent, open_ = shared.value, zstandard.ZstdDecompressor()
        for b in batches:
            coded, holes, words = b.columns[kept:]
            pairs = words.flatten()
            pos, lists = pairs.field(0).to_numpy(), pairs.field(1)
            values, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            word_at, hole_at = words.offsets.to_numpy() - words.offsets[0].as_py(), holes.offsets.to_numpy() - holes.offsets[0].as_py()
            hole = holes.flatten().to_numpy()
            found = []
            for row, data in enumerate(coded.to_pylist()):
                planes = np.frombuffer(open_.decompress(data), np.uint8).reshape(3, -1)
                number = planes[0].astype(np.int32) | planes[1].astype(np.int32) << 8 | planes[2].astype(np.int32) << 16
                at = np.flatnonzero(number == 0)
                if not len(at):
                    found.append(_spread(frequent.ids, frequent.at, number - 1)[0])
                    continue
                own = np.empty(word_at[row + 1] - word_at[row], np.int64)
                own[pos[word_at[row] : word_at[row + 1]]] = np.arange(word_at[row], word_at[row + 1])
                own = own[hole[hole_at[row] : hole_at[row + 1]]]
                size = np.ones(len(number), np.int64)
                usual = np.flatnonzero(number)
                a, size[usual] = _spread(frequent.ids, frequent.at, number[usual] - 1)
                c, size[at] = _spread(values, offsets, own)
                is_hole = np.repeat(number == 0, size)
                out = np.empty(len(is_hole), np.int32)
                out[is_hole], out[~is_hole] = c, a
                found.append(out)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = pa.array(np.concatenate(found) if found else np.zeros(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], pa.ListArray.from_arrays(pa.array(ends), flat)], names)

    return run


def encode(docs: DataFrame, pieces: Pieces, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add ``ids``, the piece ids of each whole text.  Without ``keep_text`` the result has no text, which then needn't move."""
    spark = docs.sparkSession
    bounded_batches(spark)
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(GROUPS))
    docs = without(docs, "ids")
    counted = stored(_often(docs, text, pieces), "pieces-words")
    chars = counted.filter("w IS NULL").agg(F.sum("n")).first()[0] or 0
    tasks = min(TASKS, 1 + chars // TASK_CHARS)
    some = stored(_frequent(counted.filter("w IS NOT NULL")), "pieces-frequent")
    rows = stored(encode_words(some, pieces, 1 + FREQUENT // 16_384), "pieces-encoded").toArrow()
    shared = spark.sparkContext.broadcast(Frequent(rows))
    columns = [f for f in docs.schema.fields if keep_text or f.name != text]
    names = [f.name if keep_text or f.name != text else None for f in docs.schema.fields]
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in columns)
    coded = docs.mapInArrow(_coded(shared, pieces.neighbours, docs.columns.index(text), names), f"{ddl}_coded binary, _holes array<int>, _words array<string>")
    coded = coded.withColumn("_key", F.monotonically_increasing_id()).repartition(tasks, "_key")
    row = [F.col(f"`{f.name}`") for f in columns] + [F.col("_coded"), F.col("_holes")]
    words = coded.select("_key", F.struct(*row).alias("_row"), F.posexplode("_words").alias("_pos", "w"))
    words = words.withColumn("_row", F.when(F.col("_pos") == 0, F.col("_row")))  # a row goes with its first word
    encoded = _folded(words, pieces, ["_key", "_pos"], ["_row"])
    back = encoded.groupBy("_key").agg(F.first("_row", ignorenulls=True).alias("_row"), F.collect_list(F.struct("_pos", "ids")).alias("_own"))
    out = [f.name for f in columns] + ["ids"]
    return back.select("_row.*", "_own").mapInArrow(_filled(shared, len(columns), out), f"{ddl}ids array<int>")


def decode(encoded: DataFrame, pieces: Pieces, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of piece ids; bytes that aren't UTF-8 become U+FFFD, ids that the model lacks nothing."""
    size = max((i for _, i, _ in pieces.rows), default=0)
    table = [b""] * (max(size, pieces.bytes_at + 255) + 1)
    for p, i, _ in pieces.rows:
        table[i] = p.replace(SPACE, " ").encode()
    for k in range(256 if pieces.bytes_at >= 0 else 0):
        table[pieces.bytes_at + k] = bytes([k])
    shared = encoded.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        t = shared.value
        return pd.Series([b"".join(map(t.__getitem__, x[(x >= 0) & (x < len(t))].tolist()))[1:].decode("utf-8", "replace") if x is not None else None for x in column])

    return encoded.withColumn(out, text_of(F.col(ids)))
