import math
import random
import re
from collections import Counter

import pytest

from shardflow.llm.search import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, length = len(counts), sum(n for _, _, n in counts)
    df = Counter(w for _, c, _ in counts for w in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in counts:
            m = 50 + (50 * n * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if w in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k])]
    return out


def key(row):
    return repr(tuple(row))


@pytest.mark.parametrize("block", [2000, 3])
def test_brute_force_with_ties(spark, block):
    r = random.Random(5)
    words = ["Ab", "ab9", "é", "été", "x", "the", "日本", "q7"]
    docs = [(k, " ".join(r.choice(words) for _ in range(r.randrange(0, 9)))) for k in range(200)]
    docs += [(500 + k, "the x the") for k in range(30)] + [(None, "the x the"), (900, None), (901, "..")]
    items = [("a", "the X"), ("b", "ÉTÉ été ab"), ("c", None), ("d", "nowhere"), ("e", "日本-q7, q7"), ("f", "AB9!"), ("g", "the the x é")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = search(d, spark.createDataFrame(items, "item_id string, text string"), k=40, block=block)
    assert sorted(map(key, got.select("item_id", "rank", "doc_id", "score").collect())) == sorted(map(key, brute(docs, items, 40)))


def test_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "one"), (1, "one"), (2, ""), (3, "no id"), (None, "émigré upper")], "item_id long, text string")
    got = search(odd.withColumn("rank", odd["doc_id"]), items, k=5).collect()
    assert sorted((r["item_id"], r["rank"], r["doc_id"]) for r in got if r["item_id"] == 1) == [(1, 1, 4), (1, 1, 4), (1, 2, 4), (1, 2, 4)]
    assert [r["doc_id"] for r in got if r["item_id"] is None] == [5]
    assert {r["doc_id"] for r in got if r["item_id"] == 3} == {None}
    assert search(odd.limit(0), items).count() == 0 and search(odd, items.limit(0)).count() == 0
