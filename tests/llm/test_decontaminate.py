import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shardflow.llm import decontaminate as decontamination
from shardflow.llm.decontaminate import ItemIndex, decontaminate, distance, locate, locate_all, with_matches

from .conftest import WORDS


def slow_distance(item, window):
    row = [0] * (len(window) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(window, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("ab ", min_size=1, max_size=80), st.text("ab ", max_size=90))
def test_distance(item, window):
    assert distance(item, window) == slow_distance(item, window)


def test_distances_of_many_windows():
    """Items of one to some words of bits, windows of all lengths, some that begin with an item's characters."""
    r = random.Random(9)
    for words in (1, 2, 5):
        items = ["".join(r.choice("abc é\U0001f600") for _ in range(r.randrange(64 * words - 63, 64 * words + 1))) for _ in range(12)] + ["a" * 64 * words]
        text = "".join(r.choice("abcd é") + r.choice([x[: r.randrange(200)] for x in items]) for _ in range(40))
        which = np.array([r.randrange(len(items)) for _ in range(300)])
        low = np.array([r.randrange(len(text) - 1) for _ in which])
        high = np.array([min(len(text), a + 1 + r.randrange(100 * words)) for a in low])
        points = lambda x: np.frombuffer(x.encode("utf-32-le"), np.uint32)
        best, end = locate_all([points(x) for x in items], which, points(text), low, high)
        assert list(zip(best, end, strict=True)) == [locate(items[i], text[a:b]) for i, a, b in zip(which, low, high, strict=True)]


def test_windows_of_all_items_are_located_together(monkeypatch):
    """Items of any lengths in one call, and one call for each run of texts."""
    r = random.Random(10)
    items = ["".join(r.choice("abc é\U0001f600") for _ in range(n)) for n in (1, 2, 63, 64, 65, 127, 128, 200, 320)]
    text = "".join(r.choice("abcd é") + r.choice([x[: r.randrange(330)] for x in items]) for _ in range(60))
    which = np.array([r.randrange(len(items)) for _ in range(400)])
    low = np.array([r.randrange(len(text) - 1) for _ in which])
    high = np.array([min(len(text), a + 1 + r.randrange(450)) for a in low])
    points = lambda x: np.frombuffer(x.encode("utf-32-le"), np.uint32)
    for part in (1 << 18, 2000):
        monkeypatch.setattr(decontamination, "PART", part, raising=False)
        best, end = locate_all([points(x) for x in items], which, points(text), low, high)
        assert list(zip(best, end, strict=True)) == [locate(items[i], text[a:b]) for i, a, b in zip(which, low, high, strict=True)]
    calls = []
    monkeypatch.setattr(decontamination, "locate_all", lambda *x: calls.append(1) or locate_all(*x))
    passages = [(k, " ".join(word(r) for _ in range(n))) for k, n in enumerate((15, 30, 45, 60))]
    assert [[m[0] for m in x] for x in ItemIndex(passages, 20).matches(pa.array([t for _, t in passages]))] == [[0], [1], [2], [3]]
    assert len(calls) == 1


def word(r):
    return r.choice(WORDS) + str(r.randrange(200))


@pytest.fixture(scope="module")
def items():
    r = random.Random(1)
    return [(k, " ".join(word(r) for _ in range(r.choice([1, 3, 8, 20, 40])))) for k in range(60)]


def test_recall_of_edited_passages(items):
    r = random.Random(2)
    long = [x for x in items if len(x[1].split()) >= 20]
    index, texts, want = ItemIndex(items, 20), [], []
    for k in range(200):
        i, t = long[k % len(long)]
        w = t.split()
        for _ in range(len(w) // 10):
            at = r.randrange(len(w))
            w[at : at + 1] = r.choice([[], ["other"], [w[at], "more"]])
        around = [word(r) for _ in range(60)]
        texts.append(" ".join(around[:30] + w + around[30:]))
        low = " ".join(w).lower()
        want.append((i, 100 * distance(t.lower(), low) <= 20 * len(t)))
    found = [{m[0] for m in x} for x in index.matches(pa.array(texts))]
    assert np.mean([i in f for f, (i, near) in zip(found, want, strict=True) if near]) > 0.98


def edited(r, text, rate, kinds):
    out = []
    for c in text:
        kind = r.choice(kinds) if r.random() < rate else ""
        out.append({"": c, "replace": r.choice("abcdefghijklmnopqrstuvwxyz "), "insert": c + r.choice("abcdefghij"), "delete": ""}[kind])
    return "".join(out)


@pytest.mark.parametrize("rate", [0.05, 0.10, 0.15, 0.20])
@pytest.mark.parametrize("kinds", [("replace",), ("replace", "insert", "delete")])
def test_recall_of_edited_characters(rate, kinds):
    """Against the exact distance of every item to every whole text, that is over all windows."""
    r = random.Random(int(rate * 100))
    prose = lambda n: " ".join("".join(r.choice("aeiouslnrtdm") for _ in range(r.choice([2, 3, 4, 5, 7, 9]))) for _ in range(n))
    items = [(k, prose(r.choice([15, 20, 38, 56]))) for k in range(40)]
    texts = [" ".join(f"{prose(40)} {edited(r, items[k % 40][1], rate, kinds)} {prose(40)}".split()) for k in range(160)]
    truth = {(k, i): d for k, t in enumerate(texts) for i, x in items[k % 40 : k % 40 + 2] if 100 * (d := distance(x, t)) <= 20 * len(x)}
    got = {(k, i): d for k, found in enumerate(ItemIndex(items, 20).matches(pa.array(texts))) for i, d, _ in found}
    assert len(truth) > 30
    assert np.mean([pair in got for pair in truth]) >= 0.9
    assert all(d >= truth[pair] for pair, d in got.items() if pair in truth)
    assert all(100 * d <= 20 * len(items[i][1]) for (_, i), d in got.items())


def test_where_a_passage_begins_and_blocks(spark):
    """One row for each item, the same whatever the blocks; an item's nearest text counts."""
    text = "one two three " + " ".join(WORDS) + " end"
    bench = spark.createDataFrame([(1, " ".join(WORDS)), (1, " ".join(WORDS[:-1]) + " omexa"), (1, " ".join(reversed(WORDS))), (2, " ".join(WORDS[4:20]))], "item_id long, text string")
    docs = spark.createDataFrame([(1, text), (1, text), (2, None), (3, "")], "doc_id long, Text string")
    for size in (1 << 20, 50):
        rows = sorted((x["doc_id"], [tuple(m) for m in x["matches"]]) for x in with_matches(docs, bench, block_bytes=size).collect())
        assert rows == [(1, [(1, 0, 3), (2, 0, 7)])] * 2 + [(2, []), (3, [])]
    assert "matches" in decontaminate(docs.withColumn("matches", docs["doc_id"]), bench).columns


def test_exact_passages_and_clean_texts(spark, items, odd):
    r = random.Random(3)
    rows = [(k, f"{word(r)}, {word(r)} {t.upper()}! {word(r)}") for k, t in items] + [(1000 + k, " ".join(word(r) for _ in range(200))) for k in range(50)]
    docs = spark.createDataFrame([(*x, 7) for x in rows], "doc_id long, text string, matches int")
    bench = spark.createDataFrame([*items, (500, None), (501, "..."), (None, "x"), items[0]], "item_id long, text string")
    for size in (16 << 20, 2000):
        got = {x["doc_id"]: {m["item_id"]: m["distance"] for m in x["matches"]} for x in with_matches(docs, bench, block_bytes=size).collect()}
        assert all(got[k].get(k) == 0 for k, _ in items)
        short = {k for k, t in items if len(t.split()) < 8}
        assert all(set(got[1000 + k]) <= short for k in range(50))
    bench = bench.filter("item_id <= 60 AND size(split(text, ' ')) > 5")
    clean = decontaminate(odd, bench)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    assert decontaminate(odd.limit(0), bench).count() == 0 and decontaminate(odd, bench.limit(0)).count() == odd.count()
