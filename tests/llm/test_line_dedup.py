import random
from collections import Counter

import pytest

from shardflow.llm.common import WHITE
from shardflow.llm.line_dedup import dedup_lines


def key(line):
    return line.encode().strip(WHITE).lower().decode()


def brute(texts, min_docs):
    seen = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    return [[x for x in (t or "").split("\n") if seen[key(x)] < min_docs] for t in texts]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(1)
    lines = [f"Line {k} É" for k in range(40)] + [" line 3 É\t", "", "  "]
    return [None, "", *["\n".join(r.choice(lines) for _ in range(r.randrange(1, 8))) for _ in range(300)]]


@pytest.mark.parametrize("options", [{}, {"bits": 64}, {"broadcast_keys": 0}])
def test_brute_force(spark, texts, options):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in dedup_lines(docs, min_docs=30, **options).collect()}
    for k, left in enumerate(brute(texts, 30)):
        n = len((texts[k] or "").split("\n"))
        assert (got[k]["text"] or "") == "\n".join(left) and got[k]["n_lines"] == n and got[k]["n_dropped"] == n - len(left)


@pytest.mark.parametrize("broadcast_keys", [1000, 0])
def test_keep_first(spark, texts, broadcast_keys):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] or "" for r in dedup_lines(docs, min_docs=30, keep_first=True, broadcast_keys=broadcast_keys).collect()}
    seen = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    done = set()
    for i, t in enumerate(texts):
        left = []
        for x in (t or "").split("\n"):
            if seen[key(x)] < 30 or key(x) not in done:
                left.append(x)
            if seen[key(x)] >= 30:
                done.add(key(x))
        assert got[i] == "\n".join(left)


@pytest.mark.parametrize("broadcast_keys", [1000, 0])
def test_null_and_repeated_ids(spark, texts, broadcast_keys):
    """What a row loses depends on its text alone, whatever its doc_id; equal by both ways."""
    ids = [None if k % 3 == 0 else 7 if k % 3 == 1 else k for k in range(len(texts))]
    docs = spark.createDataFrame([(k, i, t) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], "row long, doc_id long, text string")
    got = {r["row"]: (r["text"] or "", r["n_dropped"]) for r in dedup_lines(docs, min_docs=30, broadcast_keys=broadcast_keys).collect()}
    assert got == {k: ("\n".join(left), len((texts[k] or "").split("\n")) - len(left)) for k, left in enumerate(brute(texts, 30))}


def test_keep_first_by_both_ways(spark, texts):
    docs = spark.createDataFrame([(k, None if k % 50 == 9 else k // 2, t) for k, t in enumerate(texts)], "row long, doc_id long, text string")
    one, other = ({(r["row"], r["text"]) for r in dedup_lines(docs, min_docs=30, keep_first=True, broadcast_keys=n).collect()} for n in (1000, 0))
    assert one == other


def test_odd_rows(spark, odd):
    out = dedup_lines(odd, min_docs=2)
    assert sorted(out.columns) == sorted({*odd.columns, "n_dropped"})
    rows = out.collect()
    assert len(rows) == odd.count()
    assert [r["n_dropped"] for r in rows if r["doc_id"] == 4] == [1, 1]
    assert [(r["n_lines"], r["n_dropped"], r["text"]) for r in rows if r["doc_id"] in (6, 7)] == [(1, 1, "")] * 2
    assert [r["n_lines"] for r in rows if r["doc_id"] in (1, 2)] == [1, 1]
    assert dedup_lines(odd.limit(0)).count() == 0
