import random
import re
from collections import Counter, defaultdict

import pytest

from shardflow.llm import source_audit
from shardflow.llm.source_audit import audit_sources

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, k):
    """All terms of all groups, by the definition."""
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        found = Counter(TERM.findall((text or "").translate(LOWER)))
        groups.add((lang or "", source or ""))
        counts[lang or "", source or ""].update(found)
        df[lang or ""].update(found.keys())
    out = []
    for lang, source in groups:
        kept = [w for w, n in df[lang].items() if n >= min_docs]
        mine = [s for x, s in groups if x == lang]
        n = {s: sum(counts[lang, s][w] for w in kept) for s in mine}

        def p(count, size, kept=kept):
            return 1 + 10**9 * (count + 2) // (size + 2 * len(kept))

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        pairs = sorted((-sum(f(p(counts[lang, source][w], n[source]), p(counts[lang, s][w], n[s])) for w in kept), s.encode()) for s in mine if s != source)
        whole = Counter()
        for s in mine:
            whole.update(counts[lang, s])
        terms = []
        for w in kept:
            a, b = p(counts[lang, source][w], n[source]), p(whole[w], sum(n.values()))
            if counts[lang, source][w] and a > b:
                terms.append((-f(a, b), w.encode()))
        out += [(lang, source, "pair", i.decode(), -v, r + 1) for r, (v, i) in enumerate(pairs)]
        out += [(lang, source, "term", i.decode(), -v, r + 1) for r, (v, i) in enumerate(sorted(terms)[:k])]
    return sorted(out)


def found(spark, rows, min_docs, k):
    d = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    return sorted(map(tuple, audit_sources(d, min_docs=min_docs, k=k).select("lang", "source", "part", "item", "value", "rank").collect()))


@pytest.mark.parametrize("pairs", [source_audit.PAIRS, 7])
def test_brute_force(spark, monkeypatch, pairs):
    monkeypatch.setattr(source_audit, "PAIRS", pairs)
    r = random.Random(8)
    words = [f"W{chr(97 + a)}{chr(97 + b)}É" for a in range(26) for b in range(6)] + ["日本", "\x81z", "x"]
    rows = []
    for _ in range(400):
        lang, source = r.choice(["en", "fr", None, ""]), r.choice(["a", "b", "c", None, "é"])
        bias = words[: 1 + hash_of(lang, source)] if r.random() < 0.5 else words
        rows.append((" 7".join(r.choice(bias) for _ in range(r.randrange(0, 60))), lang, source))
    rows += [(None, "only", "empty"), ("", "only", "other"), ("rare", "de", "a")]
    assert found(spark, rows, 4, 3) == brute(rows, 4, 3)


def hash_of(lang, source):
    return (len(lang or "") * 7 + sum(map(ord, source or "q"))) % 40


def test_ties_at_the_last_rank(spark):
    """Terms with equal counts have equal values in buckets of equal bounds: the first by UTF-8 stay."""
    names = [f"{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)]
    rows = [(" ".join(names[:100]), "en", "a")] * 5 + [(" ".join(names[100:]), "en", "b")] * 5
    assert found(spark, rows, 5, 10) == brute(rows, 5, 10)


def test_odd_rows(spark, odd):
    got = audit_sources(odd.withColumn("rank", odd["doc_id"]), min_docs=2, k=5).collect()
    rows = [(r["text"], r["lang"], r["source"]) for r in odd.collect()]
    assert sorted(tuple(r) for r in got) == brute(rows, 2, 5)
    assert audit_sources(odd.limit(0)).count() == 0
