"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts and benchmark items are runs of letters and digits, A-Z lower-cased, joined by one space.  The CGK random walk reads
characters: at each step it writes the one under its pointer, and a random bit of (step, character) says whether the
pointer moves on, so that texts of small edit distance come to agree in most of the places written.  A repeat has a walk
of its own and samples some of its places.  Walks begin at each word of an item and of a text; a sample that agrees
places the whole item there, as a window of the item's size with room for the edits.  A window must be met from two words
of an item that has 8 and more to begin at, from three if it has 24, and so on (``MANY``); with ``REPEATS`` walks at each word,
items of 15 words and more are met with a probability of over 0.9 even where a fifth of their characters are edited
(tests measure it against exact distances); shorter ones have fewer places to begin.

A window that meets an item is compared by its 4-character grams first: an edit changes at most four, so a window with
fewer of the item's than its length, less 3 and 4 for each edit allowed, can't match; nor can one that has fewer of
the item's own.  The others are verified by the exact
edit distance in characters, with free ends in the window: at most ``percent`` of the item's length.

Items are broadcast in blocks of about ``block_bytes`` of text, each of which sees every text.  Null and empty texts match
nothing, and so do items without a word.  Repeated rows and items match alike; of several texts of an item and of several
places where a text has it the nearest counts, of equally near ones the first.  Other columns are kept (``matches`` is
replaced by with_matches and kept by decontaminate); empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardflow.llm.common import _LOWER, _RUN_CLASS, bounded_batches, mix, texts_of, without

#: Walks, their steps, the places sampled and those of them that a table of bits is asked for first.
REPEATS, STEPS, SAMPLES, EARLY = 6, 24, 16, 6
#: Items with so many words to begin at must be met from two of them, from three, and so on.
MANY = (8, 24, 34, 44)
TABLE_BITS, GRAM_BITS = 22, 13
#: Items of so many words of 64 characters are verified many at once, with about so many words of masks.
TOGETHER, PART = 16, 1 << 18
MATCHES = "array<struct<item_id:bigint,distance:int,first_word:int>>"


def _plain(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts as runs of letters and digits, a space behind each, and where each text begins."""
    use = _RUN_CLASS[data] == 1
    last = use.copy()
    last[:-1] &= ~use[1:]
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    last[ends] = use[ends]
    at = np.flatnonzero(use)
    plain = np.insert(_LOWER[data[at]], np.flatnonzero(last[at]) + 1, 32)
    # places of texts among the bytes kept, then among characters (bytes that begin one)
    kept = np.searchsorted(at, offsets)
    kept = kept + np.searchsorted(np.flatnonzero(last), offsets)
    chars = np.frombuffer(plain.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((plain & 0xC0) != 0x80)])
    return chars, begins[kept]


def _words(chars: np.ndarray) -> np.ndarray:
    """Where words begin."""
    return np.flatnonzero((chars != 32) & (np.concatenate([[32], chars[:-1]]) == 32)) if len(chars) else np.zeros(0, np.int64)


def _codes(chars: np.ndarray) -> np.ndarray:
    return np.concatenate([((chars ^ (chars >> 8)) & 255).astype(np.uint8), np.zeros(STEPS, np.uint8)])


def _grams(chars: np.ndarray) -> np.ndarray:
    """A number of 13 bits for each four characters."""
    c = np.concatenate([chars, np.zeros(3, chars.dtype)]).astype(np.uint64)
    g = c[:-3] | c[1:-2] << np.uint64(16) | c[2:-1] << np.uint64(32) | c[3:] << np.uint64(48)
    return (mix(g) >> np.uint64(64 - GRAM_BITS)).astype(np.int32)


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each span, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def locate(item: str, window: str) -> tuple[int, int]:
    """The least edit distance of the item and any part of the window (bit-parallel, a bit for each character), and the
    end of the first such part."""
    m, masks = len(item), {}
    for k, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for at, c in enumerate(window, 1):
        x = masks.get(c, 0)
        d = (((x & plus) + plus) ^ plus) | x | minus
        up, down = minus | (full & ~(d | plus)), plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1 & full
        down = down << 1 & full
        plus, minus = down | (full & ~(d | up)), up & d
        if score < best:
            best, end = score, at
    return best, end


def distance(item: str, window: str) -> int:
    return locate(item, window)[0]


def locate_all(items: list[np.ndarray], which: np.ndarray, chars: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``locate`` of items[which[k]] in chars[low[k]:high[k]] for all k at once, whatever their lengths.  The items of many
    windows are one long number, each with a bit to spare for what its sum carries over."""
    length = np.array([len(x) for x in items])
    words, one = length // 64 + 1, np.uint64(1)
    owner, place = np.repeat(np.arange(len(items)), length), _spans(np.zeros(len(items), np.int64), length)
    keys, row = np.unique(owner << 21 | np.concatenate(items), return_inverse=True)
    begin = np.cumsum(np.append(0, words[keys >> 21]))
    masks = np.zeros(begin[-1] + words.max(), np.uint64)  # where an item has a character; the last are those of any other
    np.bitwise_or.at(masks, begin[row] + (place >> 6), one << (place & 63).astype(np.uint64))
    width, best, end = high - low, length[which], np.zeros(len(which), np.int64)
    # windows of about the same width, as many as have some MB of masks
    order = np.argsort(width, kind="stable")
    bounds = np.flatnonzero(np.diff(np.cumsum((words[which] * width)[order]) // PART)) + 1
    for part in np.split(order, bounds) if len(order) else ():
        size, n, steps = length[which[part]], words[which[part]], int(width[part].max())
        at = np.cumsum(n) - n
        key = which[part] << 21 | chars[np.minimum(low[part] + np.arange(steps)[:, None], len(chars) - 1)]
        spot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        spot = np.where(keys[spot] == key, begin[spot], begin[-1])
        within = _spans(np.zeros(len(n), np.int64), n)
        raw = masks[np.repeat(spot, n, axis=1) + within].tobytes()
        last, bit = at + (size - 1 >> 6), (size - 1 & 63).astype(np.uint64)
        tops = np.zeros(n.sum(), np.uint64)
        tops[last] = one << bit
        ones = np.where(within < np.repeat(size >> 6, n), ~np.uint64(0), np.uint64(0))
        ones[at + (size >> 6)] = (one << (size & 63).astype(np.uint64)) - one
        full, top = (int.from_bytes(x.tobytes(), "little") for x in (ones, tops))
        plus, minus, rises, falls, step = full, 0, [], [], 8 * len(tops)
        for t in range(0, steps * step, step):
            x = int.from_bytes(raw[t : t + step], "little")
            d = (((x & plus) + plus) ^ plus) | x | minus
            up, down = minus | ((d | plus) & full ^ full), plus & d
            rises.append((up & top).to_bytes(step, "little"))
            falls.append((down & top).to_bytes(step, "little"))
            up, down = up << 1 & full, down << 1 & full
            plus, minus = down | ((d | up) & full ^ full), up & d
        rise, fall = ((np.frombuffer(b"".join(x), np.uint64).reshape(steps, -1)[:, last] >> bit & one).astype(np.int64) for x in (rises, falls))
        score = np.where(np.arange(steps)[:, None] < width[part], size + np.cumsum(rise - fall, axis=0), size)
        first = np.argmin(score, axis=0)
        least = score[first, np.arange(len(part))]
        best[part], end[part] = least, np.where(least < size, first + 1, 0)
    return best, end


class ItemIndex:
    """The samples of all repeats of a block of items."""

    def __init__(self, items: list[tuple[int, str]], percent: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.percent = percent
        self.move = rng.integers(0, 2, (REPEATS, STEPS, 256), dtype=np.int64)
        self.sampled = np.array([np.sort(rng.choice(STEPS, SAMPLES, replace=False)) for _ in range(REPEATS)])
        parts, ids = [], []
        for first, data, offsets in texts_of(pa.array([t for _, t in items], pa.string())):
            chars, at = _plain(data, offsets)
            for k in range(len(offsets) - 1):
                if at[k + 1] > at[k]:
                    parts.append(chars[at[k] : at[k + 1] - 1])
                    ids.append(items[first + k][0])
        self.ids, self.size = np.array(ids, np.int64), np.array([len(x) for x in parts], np.int64)
        self.chars = parts
        self.room = self.size * percent // 100 + 2
        #: how many 4-character grams of an item any match has at least, and the grams of each item
        self.least = self.size - 3 - 4 * (self.size * percent // 100)
        self.grams = np.zeros((len(parts), (1 << GRAM_BITS) // 8), np.uint8)
        own = [_grams(x) for x in parts]
        for k, x in enumerate(own):
            g = np.zeros(1 << GRAM_BITS, bool)
            g[x] = True
            self.grams[k] = np.packbits(g)
        self.all_grams, self.begin = np.concatenate([*own, np.zeros(0, np.int32)]), np.cumsum(self.size) - self.size
        # walks begin at the words that have a walk's length behind them; items shorter than a walk have their own number of steps
        self.steps = sorted({min(STEPS, n) for n in self.size.tolist()})
        self.tables: dict = {}
        self.need = np.ones(len(parts), np.int64)
        for s in self.steps:
            own = np.flatnonzero(np.minimum(self.size, STEPS) == s)
            chars = np.concatenate([np.append(parts[k], np.uint32(32)) for k in own])
            begin = np.concatenate([[0], np.cumsum(self.size[own] + 1)])
            at = _words(chars)
            item = np.searchsorted(begin, at, "right") - 1
            inside = at - begin[item] + s <= self.size[own][item]
            at, item = at[inside], item[inside]
            self.need[own] = 1 + np.searchsorted(MANY, np.bincount(item, minlength=len(own)), "right")
            for r in range(REPEATS):
                early, key, _ = self._walk(_codes(chars), at, s, r)
                bits = np.zeros(1 << TABLE_BITS, bool)
                bits[early] = True
                order = np.argsort(key, kind="stable")
                keys, first = np.unique(key[order], return_index=True)
                whole = np.zeros(1 << TABLE_BITS, bool)
                whole[(keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
                self.tables[s, r] = np.packbits(bits), np.packbits(whole), keys, np.append(first, len(order)), own[item[order]], (at - begin[item])[order]

    def _walk(self, codes: np.ndarray, at: np.ndarray, steps: int, r: int, known: np.ndarray | None = None):
        """Of the walks that begin at ``at``: the early samples as a number, the keys of all samples, and which walks these are
        (with ``known``, a table of bits, only those whose early samples it has)."""
        key, place, which, early, seen = np.full(len(at), r + 1, np.uint64), at.copy(), np.arange(len(at)), None, 0
        sampled = [j for j in self.sampled[r].tolist() if j < steps] if steps == STEPS else range(steps)
        last = max(sampled)
        for j in range(last + 1):
            c = codes.take(place)
            if j in sampled:
                with np.errstate(over="ignore"):
                    key = key * np.uint64(0x9E3779B97F4A7C15) + c + np.uint64(1)
                seen += 1
                if seen == min(EARLY, len(sampled)):
                    early = (mix(key) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
                    if known is not None:
                        stay = np.flatnonzero(known[early >> 3] << (early & 7).astype(np.uint8) & 128)
                        key, place, which, c = key[stay], place[stay], which[stay], c[stay]
            if j < last:
                place = place + self.move[r, j].take(c)
        return early, mix(key), which

    def _met(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows (item, first, last) of windows of the text: where the item seems to begin, at the earliest and the latest."""
        items, begins, walks = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for (s, r), (known, whole, keys, ends, item, inside) in self.tables.items():
            _, key, which = self._walk(codes, at, s, r, known)
            place = (key >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
            few = np.flatnonzero(whole[place >> 3] << (place & 7).astype(np.uint8) & 128)
            key, which = key[few], which[few]
            spot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = np.flatnonzero(keys[spot] == key)
            first, last = ends[spot[hit]], ends[spot[hit] + 1]
            pairs = _spans(first, last - first)
            items.append(item[pairs])
            walks.append(np.repeat(at[which[hit]], last - first))
            begins.append(walks[-1] - inside[pairs])
        item, begin, walk = map(np.concatenate, (items, begins, walks))
        # how many words of a window meet the item; edits may move some to the next window
        key = (item << 34) + (begin // self.room[item] + 1)
        order = np.lexsort((walk, key))
        key, walk, begin = key[order], walk[order], begin[order]
        if not len(key):
            return np.zeros((3, 0), np.int64)
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (walk[1:] != walk[:-1])
        windows, at = np.unique(key, return_index=True)
        count = np.add.reduceat(new, at, dtype=np.int64)
        first, last = np.minimum.reduceat(begin, at), np.maximum.reduceat(begin, at)
        # a window and the next are one
        two = np.append(windows[1:] == windows[:-1] + 1, False)
        after = np.minimum(np.arange(len(windows)) + 1, len(windows) - 1)
        enough = count + np.where(two, count[after], 0) >= self.need[windows >> 34]
        last = np.where(two, last[after], last)
        inner = np.append(False, two[:-1] & enough[:-1]) & ~two  # is in the window before it
        some = np.flatnonzero(enough & ~inner)
        return np.stack([windows[some] >> 34, first[some], last[some]])

    def matches(self, column: pa.Array) -> list[list[tuple[int, int, int]]]:
        """For each text (item_id, distance, first word) of the items it has."""
        out: list[dict] = [{} for _ in range(len(column))]
        for first, data, offsets in texts_of(column) if len(self.ids) else ():
            chars, bounds = _plain(data, offsets)
            at = _words(chars)
            if not len(at):
                continue
            item, begin, last = self._met(_codes(chars), at)
            low, high = np.maximum(begin - self.room[item], 0), np.minimum(last + self.size[item] + self.room[item], len(chars))
            item, low, high = (x[low < high] for x in (item, low, high))
            grams = _grams(chars)
            for a in range(0, len(item), 4096):
                part = slice(a, a + 4096)
                size = high[part] - low[part]
                g = grams[_spans(low[part], size)]
                have = self.grams[np.repeat(item[part], size), g >> 3] << (g & 7).astype(np.uint8) & 128 > 0
                count = np.add.reduceat(have, np.cumsum(size) - size, dtype=np.int64)
                some = np.flatnonzero(count >= self.least[item[part]]) + a
                some = some[self._has_grams(grams, item[some], low[some], high[some])]
                self._verify(out, first, chars, bounds, at, item[some], low[some], high[some])
        return [[(i, d, p) for i, (d, p) in sorted(x.items())] for x in out]

    def _has_grams(self, grams: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether enough of the item's grams are in the window."""
        out = np.zeros(len(item), bool)
        for a in range(0, len(item), 512):
            part = slice(a, a + 512)
            own, size = item[part], (high - low)[part]
            has = np.zeros((len(own), 1 << GRAM_BITS), bool)
            has[np.repeat(np.arange(len(own)), size), grams[_spans(low[part], size)]] = True
            n = np.maximum(self.size[own] - 3, 1)
            found = has[np.repeat(np.arange(len(own)), n), self.all_grams[_spans(self.begin[own], n)]]
            out[part] = np.add.reduceat(found, np.cumsum(n) - n, dtype=np.int64) >= self.least[own]
        return out

    def _nearest(self, chars: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``locate`` for many windows: together, but one by one for long items."""
        best, end = self.size[item], np.zeros(len(item), np.int64)
        long = best > 64 * TOGETHER
        for k in np.flatnonzero(long).tolist():
            best[k], end[k] = locate(self.chars[item[k]].tobytes().decode("utf-32-le"), chars[low[k] : high[k]].tobytes().decode("utf-32-le"))
        if not long.all():
            own, which = np.unique(item[~long], return_inverse=True)
            best[~long], end[~long] = locate_all([self.chars[i] for i in own], which, chars, low[~long], high[~long])
        return best, end

    def _verify(self, out, first, chars, bounds, at, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """The items in the texts that their windows reach into."""
        begin = np.searchsorted(bounds, low, "right") - 1
        texts = np.searchsorted(bounds, high, "left") - begin
        doc, item = _spans(begin, texts), np.repeat(item, texts)
        low, high = np.maximum(np.repeat(low, texts), bounds[doc]), np.minimum(np.repeat(high, texts), bounds[doc + 1])
        room = (high > low) & (100 * (self.size[item] - (high - low)) <= self.percent * self.size[item])
        doc, item, low, high = (x[room] for x in (doc, item, low, high))
        distances, ends = self._nearest(chars, item, low, high)
        for k in np.flatnonzero(100 * distances <= self.percent * self.size[item]).tolist():
            text, d = int(doc[k]), int(distances[k])
            start = max(int(low[k] + ends[k] - self.size[item[k]]), int(bounds[text]))
            word = int(np.searchsorted(at, start, "right") - np.searchsorted(at, bounds[text], "right"))
            own, i = out[first + text], int(self.ids[item[k]])
            own[i] = min(own.get(i, (d, word)), (d, word))


def _searcher(blocks: list):
    """Looks for the items of each block in turn; of an item with texts in several the nearest counts."""

    @F.pandas_udf(MATCHES)
    def search(texts: pd.Series) -> pd.Series:
        column, best = pa.array(texts, pa.string(), from_pandas=True), [{} for _ in texts]
        for shared in blocks:
            for own, hits in zip(best, shared.value.matches(column), strict=True):
                for i, d, p in hits:
                    own[i] = min(own.get(i, (d, p)), (d, p))
        return pd.Series([[{"item_id": i, "distance": d, "first_word": p} for i, (d, p) in sorted(own.items())] for own in best])

    return search


def _search(docs: DataFrame, benchmark: DataFrame, percent: int, text: str, item_id: str, item_text: str, block_bytes: int):
    """The column of matches."""
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.filter(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).distinct()
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // block_bytes))
    found = []
    for k in range(blocks):
        block = sorted((r["i"], r["t"]) for r in items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).toLocalIterator())
        found.append(spark.sparkContext.broadcast(ItemIndex(block, percent)))
    return _searcher(found)(F.col(text))


def with_matches(docs: DataFrame, benchmark: DataFrame, percent: int = 20, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = 2 << 20) -> DataFrame:
    """Add ``matches``: the benchmark items that each text has, with their edit distance and the word where they begin."""
    found = _search(docs, benchmark, percent, text, item_id, item_text, block_bytes)
    return without(docs, "matches").withColumn("matches", found)


def decontaminate(docs: DataFrame, benchmark: DataFrame, percent: int = 20, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = 2 << 20) -> DataFrame:
    """Documents that have no benchmark item."""
    found = _search(docs, benchmark, percent, text, item_id, item_text, block_bytes)
    return docs.withColumn("_matches", found).filter(F.size("_matches") == 0).drop("_matches")
