import random

import pytest

from shardflow.llm import ngram_join
from shardflow.llm.components import components
from shardflow.llm.ngram_join import near_duplicates

from .conftest import WORDS


def brute(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = [x for x in (t or "").lower().replace("\t", " ").replace("\n", " ").split(" ") if x]
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    ids = sorted(sets)
    group = {i: i for i in ids}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    group[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed, sizes=(40, 80)):
    r = random.Random(seed)
    rows, common = [], [r.choice(WORDS) for _ in range(30)]
    for g in range(12):
        base = [r.choice(WORDS) + str(r.randrange(9)) for _ in range(r.randrange(*sizes))]
        if g % 3 == 0:
            base[5:5] = common
        for _ in range(r.choice([1, 2, 3, 25])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                k = r.randrange(len(w))
                w[k : k + r.choice([0, 1])] = [r.choice(["Edit", "other"]) + str(r.randrange(99))] * r.choice([0, 1])
            rows.append(" ".join(w))
    rows += ["", None, "one", "ONE", "two words", "two  words", "a b c", "a b c d"]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("n", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (2, 70, 3)])
def test_brute_force(spark, n, percent, seed):
    rows = corpus(seed)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, n, percent)


def test_odd_rows(spark, odd):
    got = near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[6] == by[7] == 6 and by[1] == 1 and by[None] is None and by[4] == 4
    assert near_duplicates(odd.limit(0)).count() == 0


def test_rows_of_one_doc_id_link_by_their_own_texts(spark):
    a, b = " ".join(WORDS[:12]), " ".join(WORDS[12:])
    rows = [(2, a), (4, a), (4, b), (9, b), (None, b), (3, b + " end"), (3, b + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = {r["text"]: r["h"] for r in df.selectExpr("text", "xxhash64(text) AS h").collect()}
    got = sorted((r["doc_id"] or 0, r["text_hash"], r["component_id"]) for r in near_duplicates(df).collect())
    want = [(2, a, 2), (4, a, 2), (4, b, 3), (9, b, 3), (0, b, None), (3, b + " end", 3), (3, b + " end", 3)]
    assert got == sorted((i, hashes[t], c) for i, t, c in want)


def test_chains_of_groups(spark):
    """Groups that link through one pair of members only, among many that share shingles and don't link."""
    r = random.Random(11)
    base = [r.choice(WORDS) + str(k) for k in range(100)]
    rows = []
    for k in range(60):
        w = list(base)
        for j in range(k):
            w[(j * 37) % 100] = f"new{j if k % 3 else (j, k)}"
        rows.append((k, " ".join(w)))
    r.shuffle(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == brute(rows, 2, 80)


def test_components(spark):
    r = random.Random(3)
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(25)] + [(7, 7)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    group = {}
    for a, b in links:
        x, y = group.get(a, {a}), group.get(b, {b})
        for z in x | y:
            group[z] = x | y
    assert got == {z: min(s) for z, s in group.items() if len(s) > 1}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_queries_meet_groups_only_where_a_first_shared_shingle_can_be(spark, monkeypatch):
    """A passage that many texts have fills their prefixes: they share most of these shingles and link with no other text."""
    r = random.Random(31)
    passage = [f"common{k}" for k in range(60)]
    rows = [(k, " ".join([*(r.choice(WORDS) + str(r.randrange(10**6)) for _ in range(6)), *passage])) for k in range(60)]
    rows += [(100 + k, " ".join([*passage, *(f"own{k // 3}x{j}" for j in range(40)), f"last{k}"])) for k in range(12)]
    met = []
    keep = ngram_join.stored

    def counting(df, name):
        out = keep(df, name)
        met.extend([out.count()] if name == "ngram-met" else [])
        return out

    monkeypatch.setattr(ngram_join, "stored", counting)
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == brute(rows, 3, 90)
    assert len(met) == 1 and met[0] <= 60
