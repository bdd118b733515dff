import math
import random
import re
from collections import Counter

import pytest

from shardflow.llm.quality_rules import filter_quality, measure


def brute(text):
    t = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    windows = list(zip(w, w[1:], w[2:], strict=False))
    n = Counter(windows)
    covered = {k + d for k, x in enumerate(windows) if n[x] > 1 for d in range(3)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_measures(spark):
    texts = ["", None, "a", "a a a a a", "a b c a b c", "x y z\nx y z\n\n x\n", "a b a b a b", "é#& <|>\t%%\r\n*", "one two three four " * 3, "q w e r q w e t q w e", "a b c d a b c d b c d"]
    rows = measure(spark.createDataFrame(list(enumerate(texts)), "k int, text string")).collect()
    assert [tuple(r[n] for n in NAMES) for r in sorted(rows, key=lambda r: r["k"])] == [brute(t) for t in texts]


@pytest.mark.parametrize("keep_text", [True, False])
def test_odd_rows(spark, odd, keep_text):
    rows = filter_quality(odd, min_words=5, min_group=2, keep_text=keep_text).collect()
    assert len(rows) == odd.count() and ("text" in rows[0].asDict()) == keep_text
    kept = {r["doc_id"]: (r["n_words"], r["base_failed"], r["kept"]) for r in rows}
    assert kept[1] == (0, True, False) and kept[6][:2] == (60_000, False) and kept[None][0] == 5
    assert filter_quality(odd.limit(0)).count() == 0


def test_fences_follow_their_group(spark):
    """The same share of marks is usual in one source and far out in another."""
    plain = [(k, "word " * 60 + f"x{k}", "en", "plain") for k in range(60)]
    marks = [(100 + k, "word%%%% " * 60 + f"x{k}", "en", "marks") for k in range(60)]
    odd = [(200, "word%%%% " * 60 + "x", "en", "plain")]
    docs = spark.createDataFrame(plain + marks + odd, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in filter_quality(docs, max_repeat_percent=100, min_group=20).collect()}
    assert all(kept[k] for k in range(60)) and all(kept[100 + k] for k in range(60)) and not kept[200]


def quartiles(values):
    v = sorted(values)
    return v[math.ceil(len(v) * 0.25) - 1], v[math.ceil(len(v) * 0.75) - 1]


def test_verdicts(spark):
    """Every verdict against fences around the exact quartiles of each group, whose sketches hold all its rows."""
    r = random.Random(5)
    rows = []
    for k in range(240):
        source = "ab"[k % 2]
        stem = 4 if source == "a" else 7
        w = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(stem - 2, stem + 3))) + ("#" if r.random() < (0.01 if source == "a" else 0.3) else "") for _ in range(r.randrange(60, 200))]
        if k % 30 == 1:
            w = ["####"[: r.randrange(1, 5)] + x for x in w]
        if k % 30 == 4:
            w = [x * 4 for x in w]
        if k % 30 == 8:
            w = w[:50] + w[:30]
        lines = [" ".join(w[i : i + 6]) for i in range(0, len(w), 6)]
        if k % 30 == 13:
            lines += lines[:1] * 8
        rows.append((k, "\n".join(lines), "en", source))
    value = {}
    for k, t, _, _ in rows:
        words, chars, symbols, dup, repeat = brute(t)
        shares = [(symbols, chars, 0.5), (dup, t.count("\n") + 1, 0.1), (repeat, words, 0.5)]
        value[k] = [chars / words, *[math.log((a + c) / (b + 2 * c)) for a, b, c in shares]]
    want, decided = dict.fromkeys(value, True), set()
    for group in (0, 1):
        for j, guard in enumerate((0.1, 0.25, 0.25, 0.25)):
            low, high = quartiles(value[k][j] for k in value if k % 2 == group)
            room = 3 * max(high - low, guard)
            for k in value:
                if k % 2 == group and (value[k][j] > high + room or j == 0 and value[k][j] < low - room):
                    want[k] = False
                    decided.add(j)
    got = {x["doc_id"]: x["kept"] for x in filter_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), max_repeat_percent=100, min_group=20).collect()}
    assert got == want and decided == {0, 1, 2, 3}


def test_no_python_in_the_plan(spark, odd):
    plan = filter_quality(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
