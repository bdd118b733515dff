"""Models: held-out accuracy, exact sums against brute force, odd rows."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shardflow.llm import language_id, quality_model, toxicity
from shardflow.llm.common import hash_spans, run_hashes, texts_of, word_hashes
from shardflow.llm.toxicity import WORDS as CLASSES, _discounts, _features, _fit_models, _words, count_pairs, probabilities, score_toxicity

from .conftest import WORDS

LANGS = {"xx": "the and ing tion of to in was".split(), "yy": "der die und ung sch ein nicht keit".split(), "zz": "le que eau des mené est".split()}


def text(r, words, n):
    return " ".join("".join(r.choice(words) for _ in range(r.randrange(1, 3))) for _ in range(n))


def test_language_id(spark, odd):
    r = random.Random(1)
    rows = [(k, text(r, LANGS[x], r.randrange(2, 30)), x) for k in range(300) for x in [r.choice(sorted(LANGS))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = language_id.train(docs, F.col("doc_id") % 4 != 2)
    assert trees.langs == sorted(LANGS)
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language_id.identify(docs, trees).collect()}
    held = [(got[k][0], lang) for k, _, lang in rows if k % 4 == 2]
    assert np.mean([a == b for a, b in held]) > 0.95 and all(0 <= s <= 1 for _, s in got.values())
    odd_rows = language_id.identify(odd, trees).collect()
    und = {x["doc_id"] for x in odd_rows if x["lang_pred"] == "und"}
    assert {1, 2, 3} <= und and 6 not in und and len(odd_rows) == odd.count()
    assert language_id.train(docs.limit(0), F.lit(True)) is None
    assert language_id.identify(odd, None).filter("lang_pred <> 'und'").count() == 0


def test_code_lengths_do_not_depend_on_batches(spark):
    r = random.Random(2)
    docs = spark.createDataFrame([(k, text(r, LANGS[x], 20), x) for k in range(60) for x in [r.choice(sorted(LANGS))]], "doc_id long, text string, lang string")
    trees = language_id.train(docs, F.lit(True))
    texts = [None, "", "é", text(r, LANGS["xx"], 300_000), text(r, LANGS["yy"], 5), "the"]
    together = trees.code_lengths(pa.array(texts, pa.string()))
    alone = np.concatenate([trees.code_lengths(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(together, alone) and not together[:2].any()
    # a byte after a byte: by hand for the last text, from the rows of its contexts
    data, bits = b"   the", np.zeros(len(trees.langs))
    for k in range(3, 6):
        c3, c2, c1, x = (trees.symbol[data[k - j]] for j in (3, 2, 1, 0))
        bits += trees.cost[trees.row[(c3 * trees.s + c2) * trees.s + c1] * trees.s + x]
    assert np.allclose(together[5], bits)


def test_quality_model(spark, odd):
    r = random.Random(3)
    bad, fair, good = WORDS[:8] + ["%%%"], WORDS[6:16], WORDS[14:]
    rows = [(k, " ".join(r.choice([bad, fair, good][g]) for _ in range(30)), g) for k in range(400) for g in [r.randrange(3)]]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, g) for k, _, g in rows] + [(5, None), (None, 1), (7, rows[7][2])], "doc_id long, quality int")
    model = quality_model.train(docs, labels, train_on=F.col("doc_id") % 3 != 0)
    assert list(model.grades) == [0, 1, 2] and model.thresholds[0] < model.thresholds[1]
    got = {x["doc_id"]: x for x in quality_model.score_quality(docs, model, wanted=1, least=0.5).collect()}
    held = [(got[k]["expected_grade"], got[k]["tail_prob"], g) for k, _, g in rows if k % 3 == 0]
    assert np.mean([round(e) == g for e, _, g in held]) > 0.9 and np.mean([(p >= 0.5) == (g >= 1) for _, p, g in held]) > 0.9
    out = quality_model.score_quality(odd, model).collect()
    assert len(out) == odd.count() and all(isinstance(x["kept"], bool) and 0 <= x["tail_prob"] <= 1 for x in out)
    assert quality_model.train(docs, labels.limit(0)) is None
    assert quality_model.score_quality(odd, None).filter("NOT kept").count() == 0
    assert quality_model.score_quality(odd.limit(0), model).count() == 0


def test_ordinal_gradient():
    """The fit reaches the frequencies of grades when there is nothing to tell them apart."""
    grades = np.array([0.0] * 10 + [1.0] * 30 + [3.0] * 60)
    n = len(grades)
    model = quality_model.fit(np.zeros(n, np.int64), np.zeros(n), np.arange(n + 1), grades, steps=400)
    assert model.at_least(np.zeros(1))[0] == pytest.approx([0.9, 0.6], abs=0.02)


def test_toxicity(spark, odd):
    r = random.Random(4)
    slurs = ["vile", "filth", "rotten"]
    rows = []
    for k in range(700):
        y = int(r.random() < 0.3)
        w = [r.choice(WORDS) + str(r.randrange(30)) for _ in range(r.randrange(10, 60))]
        for _ in range(3 * y):
            w.insert(r.randrange(len(w)), r.choice(slurs) + r.choice(["", ",", "."]))
        rows.append((k, " ".join(w), y))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in score_toxicity(docs, labels, F.col("doc_id") % 5 != 0).collect()}
    held = [(got[k]["predicted"], y) for k, _, y in rows if k % 5 == 0]
    assert np.mean([p == y for p, y in held]) > 0.95
    out = score_toxicity(odd.withColumn("doc_id", F.col("doc_id") + 10_000).unionByName(docs, allowMissingColumns=True), labels, F.lit(True)).filter("doc_id > 9000 OR doc_id IS NULL").collect()
    assert len(out) == odd.count() and all(0 <= x["score"] <= 1 for x in out)
    none = score_toxicity(odd, labels.limit(0), F.lit(True)).collect()
    assert len(none) == odd.count() and {x["score"] for x in none} == {0.0}


def test_toxic_expressions_of_ordinary_words(spark):
    """Only the order of two words, which follow every other word in both classes, tells the classes apart."""
    r = random.Random(8)
    expressions = [("good", "riddance"), ("drop", "dead"), ("get", "lost")]
    rows = []
    for k in range(900):
        y = int(r.random() < 0.4)
        w = [r.choice(WORDS + [x for e in expressions for x in e]) for _ in range(r.randrange(30, 90))]
        w += [f"rare{r.randrange(3000)}" for _ in range(20)]
        r.shuffle(w)
        for _ in range(5):
            a, b = r.choice(expressions)
            w.insert(r.randrange(len(w)), f"{a} {b}" if y else f"{b} {a}")
        rows.append((k, " ".join(w), y))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    got = {x["doc_id"]: x["predicted"] for x in score_toxicity(docs, labels, F.col("doc_id") % 5 != 0).collect()}
    assert np.mean([got[k] == y for k, _, y in rows if k % 5 == 0]) > 0.9


def kneser_ney(rows, weight):
    """P(w | v) of a class, from the definition, and U of its words."""
    n = [Counter(), Counter()]
    for words, y in rows:
        n[y].update(zip(["<s>", *words], words, strict=False))
    n.append(n[0] + n[1])
    d = [_discounts(*[sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]) for c in n]
    t = [Counter(w for _, w in c) for c in n]
    u = []
    for c in (0, 1):
        dt = _discounts(*[sum(x == k for x in t[c].values()) for k in (1, 2, 3, 4)])
        left = sum(x - dt[min(x, 3)] for x in t[c].values())
        u.append(lambda w, c=c, dt=dt, left=left: 0.7 * (t[c][w] - dt[min(t[c][w], 3)]) / left + 0.3 * (t[2][w] + 0.5) / (sum(t[2].values()) + CLASSES / 2))

    def p(c, v, w):
        mine, both = ({b: x for b, x in n[k].items() if b[0] == v} for k in (c, 2))
        s = u[c](w)
        if both:
            s = (both.get((v, w), 0) - d[2][min(both.get((v, w), 0), 3)] + sum(d[2][min(x, 3)] for x in both.values()) * s) / sum(both.values())
        x = mine.get((v, w), 0)
        return (x - d[c][min(x, 3)] + (sum(d[c][min(m, 3)] for m in mine.values()) + weight) * s) / (sum(mine.values()) + weight)

    return p, u


def test_kneser_ney_by_brute_force_and_sums_to_one(spark):
    r = random.Random(12)
    rows = [([r.choice(WORDS[:4] if r.random() < 0.5 else WORDS) for _ in range(r.randrange(1, 30))], int(r.random() < 0.3)) for _ in range(60)]
    model = _fit_models(count_pairs(spark.createDataFrame([(" ".join(w), y) for w, y in rows], "text string, _label int"), "text"))
    number = lambda w: 0 if w == "<s>" else int(next(_words(pa.array([w])))[2][0])
    words, every = sorted({w for x, _ in rows for w in x}), np.arange(CLASSES)
    assert len({number(w) for w in words}) == len(words)
    for weight in (10.0, 1000.0):
        p, u = kneser_ney(rows, weight)
        for v in [*words, "<s>", "never"]:
            before = np.full(CLASSES, number(v))
            got = probabilities(model, before, every, (weight,))[0]
            assert got.sum(axis=1) == pytest.approx([1, 1], abs=1e-6)
            assert np.allclose(got[:, [number(w) for w in words]], [[p(c, v, w) for w in words] for c in (0, 1)], rtol=1e-4)
        assert model["own"].sum(axis=1, dtype=float) == pytest.approx([1, 1], abs=1e-6)
    texts = [None, "", "alpha beta gamma", "never seen alpha", " ".join(rows[0][0])]
    for t, x in zip(texts, _features(model, pa.array(texts, pa.string()), (1000.0,)), strict=True):
        w = (t or "").split()
        each = [np.log(p(1, v, x) / p(0, v, x)) for v, x in zip(["<s>", *w], w, strict=False)] or [0]
        alone = [np.log(u[1](x) / u[0](x)) for x in w] or [0]
        assert np.allclose(x, [np.mean(each), np.mean(sorted(each)[-3:]), np.mean(alone), np.mean(sorted(alone)[-3:])], atol=1e-4)


def test_pairs_that_are_not_kept_leave_their_share(spark, monkeypatch):
    """With few places most bigrams are lost; the models still sum to 1."""
    monkeypatch.setattr(toxicity, "PAIRS", 7)
    pairs = spark.createDataFrame([(v, w, (v * w) % 5 + 1, (v + w) % 3) for v in range(12) for w in range(1, 12)], "v int, w int, n0 int, n1 int")
    model = _fit_models(pairs)
    for v in range(13):
        assert probabilities(model, np.full(CLASSES, v), np.arange(CLASSES), (10.0,))[0].sum(axis=1) == pytest.approx([1, 1], abs=1e-6)


def test_one_class_gives_its_share(spark):
    docs = spark.createDataFrame([(k, "one two") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(40)], "doc_id long, toxic int")
    assert {tuple(x) for x in score_toxicity(docs, labels, F.lit(True)).select("score", "predicted").collect()} == {(1.0, 1)}


def test_hashes_do_not_depend_on_batches():
    r = random.Random(6)
    texts = [" ".join(r.choice(WORDS) for _ in range(r.randrange(0, 50))) + r.choice(["", "\n", "é ü"]) for _ in range(50)] + ["", None, "A b", "a B"]
    column = pa.array(texts, pa.string())
    for f in (lambda d, o: word_hashes(d, o), lambda d, o: run_hashes(d, o, True)):
        together = []
        for _, d, o in texts_of(column):
            h, b = f(d, o)
            together += [h[x:y].tolist() for x, y in zip(b[:-1], b[1:], strict=True)]
        alone = []
        for k in range(len(texts)):
            for _, d, o in texts_of(column.slice(k, 1), 64):
                h, b = f(d, o)
                alone.append(h.tolist())
        assert together == alone and together[-1] == together[-2]
    data = np.frombuffer(b"abcabcabc", np.uint8)
    start, end = np.array([0, 3, 6]), np.array([3, 6, 9])
    assert len(set(hash_spans(data, start, end, 4).tolist())) == 1


def test_no_pair_is_left_out(spark):
    """More bigrams than any table of one place for each had room for, and counts beyond those kept beside them."""
    pairs = spark.range(3_000_000).selectExpr("cast(id % 1009 * 250 as int) v", "cast(id div 1009 as int) w", "cast(id % 7 + if(id % 100003 = 0, 20000, 0) as int) n0", "cast(id % 3 + if(id % 100019 = 0, 16380, 0) as int) n1")
    k = np.arange(0, 3_000_000, 1)
    found = toxicity._bigrams(_fit_models(pairs)["files"]).counts(k % 1009 * 250, k // 1009)
    assert (found == [k % 7 + 20000 * (k % 100003 == 0), k % 3 + 16380 * (k % 100019 == 0)]).all()
    assert not toxicity._bigrams(_fit_models(pairs)["files"]).counts(k[:999] % 1009 * 250 + 1, k[:999]).any()


def test_the_fit_takes_little_more_memory_than_its_features():
    r = np.random.default_rng(5)
    bounds = np.append(0, np.cumsum(r.integers(1, 1000, 2000)))
    index, value = r.integers(0, 1 << quality_model.BITS, bounds[-1]).astype(np.int32), r.random(bounds[-1]).astype(np.float32)
    tracemalloc.start()
    quality_model.fit(index, value, bounds, r.integers(0, 3, 2000), steps=2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 16 * len(index), most
