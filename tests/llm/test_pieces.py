import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shardflow.llm import pieces as P
from shardflow.llm.pieces import Pieces, decode, encode, encode_words, load_pieces
from shardflow.llm.queries import PIECE_MODEL

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)


def check(rows, model):
    for r in rows:
        assert r["ids"] == model.encode(r["text"] or ""), r["text"][:80]
        assert r["decoded"] == (r["text"] or "").replace("▁", " ")


@pytest.mark.parametrize("frequent", [1 << 20, 40, 0])
def test_the_library_gives_the_same_ids(spark, model, monkeypatch, frequent):
    monkeypatch.setattr(P, "FREQUENT", frequent)
    r = random.Random(2)
    parts = ["the", "quick", "théâtre", "ing", ".", "...", ",", "\n", "  ", "    ", "▁", "123", "日本", "🙂", "\t", "%%%", "x=1;", "don't", "U.S.A.", "(a)", "\x00", "zzzzqqqq", "-->", "é"]
    texts = ["".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randrange(1, 30))) for _ in range(120)]
    texts += ["", None, " ", "   ", "a", "▁", "\n", " lead", "trail ", "a  b", "word" * 40, "9" * 300, "é" * 100, texts[0], texts[0]]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    p = load_pieces(PIECE_MODEL)
    out = decode(encode(docs, p), p)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    rows = out.collect()
    assert len(rows) == len(texts)
    check(rows, model)


def test_odd_rows(spark, model, odd):
    p = load_pieces(PIECE_MODEL)
    rows = decode(encode(odd, p), p).collect()
    assert len(rows) == odd.count()
    check(rows, model)
    assert encode(odd.limit(0), p).count() == 0


def test_viterbi_of_a_unigram_table(spark):
    table = (("a", 3, -2.0), ("b", 4, -2.5), ("ab", 5, -4.0), ("ba", 6, -3.0), ("aba", 7, -7.5), ("▁", 8, -1.0), ("▁a", 9, -2.5), ("bb", 10, -6.0))
    p = Pieces(table, -1, 0, bpe=False)
    score = {t: (-s, i) for t, i, s in table}

    def best(w):
        at = [(0.0, [])]
        for e in range(1, len(w) + 1):
            found = [(at[s][0] + score[w[s:e]][0], [*at[s][1], score[w[s:e]][1]]) for s in range(e) if w[s:e] in score]
            at.append(min(found or [(at[e - 1][0] + 100.0, [*at[e - 1][1], 0])], key=lambda x: x[0]))
        return at[-1][0]

    r = random.Random(5)
    words = sorted({"▁" + "".join(r.choice("abc") for _ in range(r.randrange(1, 9))) for _ in range(60)})
    rows = encode_words(spark.createDataFrame([(w, 1) for w in words], "w string, n long"), p).collect()
    back = {i: t for t, i, _ in table}
    cost = {i: -s for _, i, s in table} | {0: 100.0}
    assert {x["w"] for x in rows} == set(words)
    for x in rows:
        assert sum(cost[i] for i in x["ids"]) == pytest.approx(best(x["w"]))
        if 0 not in x["ids"]:
            assert "".join(back[i] for i in x["ids"]) == x["w"]


def test_rows_move_once(spark, odd):
    plan = encode(odd, load_pieces(PIECE_MODEL))._jdf.queryExecution().executedPlan().toString()
    assert plan.replace("BroadcastExchange", "").count("Exchange") == 1 and "CartesianProduct" not in plan and "SortMergeJoin" not in plan


def test_long_words(spark, model):
    """Boundaries in one number and in many: the words here have no cuts, or few."""
    r = random.Random(9)
    words = ["▁" + "".join(r.choice("aeinorst") for _ in range(n)) for n in (1, 58, 59, 60, 61, 62, 63, 64, 65, 96, 97, 200, 1000)]
    rows = encode_words(spark.createDataFrame([(w, 1) for w in words], "w string, n long"), load_pieces(PIECE_MODEL)).collect()
    assert {x["w"]: x["ids"] for x in rows} == {w: model.encode(w[1:]) for w in words}


def test_kind_of_the_model():
    assert load_pieces(PIECE_MODEL).bpe
    assert P._is_bpe(b"\x12\x02\x18\x02") and not P._is_bpe(b"\x12\x02\x18\x01") and not P._is_bpe(b"")
    with pytest.raises(ValueError):
        P._is_bpe(b"\x12\x02\x18\x03")
    with pytest.raises(ValueError, match="order of their ranks"):
        Pieces((("a", 0, 0.0), ("b", 1, -1.0), ("c", 2, -2.0), ("bc", 3, -9.0), ("abc", 4, -3.0)), -1, 0, bpe=True).merges()


CUTTER = P.Cutter(load_pieces(PIECE_MODEL).neighbours)


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(text=st.text("ab ▁1é\n漢.", max_size=40))
def test_words_are_encoded_by_themselves(model, text):
    for _, whole, start, end, _, _ in CUTTER.words([text]):
        words = [whole[a:b] for a, b in zip(start, end, strict=True)]
        assert "".join(words) == ("▁" + text.replace(" ", "▁") if text else "")
        # a line feed is in no piece: the space and the byte before a word are taken off again
        assert sum((model.encode("\n" + w)[2:] for w in words), []) == model.encode(text)


def test_words_of_different_runs_of_texts_are_frequent(spark, monkeypatch):
    monkeypatch.setattr(P, "RUN", 8)
    p = load_pieces(PIECE_MODEL)
    docs = spark.createDataFrame([(t,) for t in ["the quick", "a lazy dog", "the lazy", "quick once"]], "text string").coalesce(1)
    found = {r["w"]: r["n"] for r in P._often(docs, "text", p).collect()}
    assert found.pop(None) == sum(1 + len(t) for t in ["the quick", "a lazy dog", "the lazy", "quick once"])
    assert {w.strip(P.SPACE): n for w, n in found.items()} == {"the": 2, "quick": 2, "lazy": 2}


def test_counts_that_are_given_up_on_the_way_add_up(spark, monkeypatch):
    monkeypatch.setattr(P, "NAMED", 2)
    words = P.Repeated()
    cutter, text = P.Cutter(load_pieces(PIECE_MODEL).neighbours), "the lazy dog saw the lazy dog once"
    for _, whole, start, end, h, _ in cutter.words([text]):
        words.add(whole, start, end, h)
    assert words.full()
    found, n = words.taken()
    assert {w.strip(P.SPACE): k for w, k in zip(found.to_pylist(), n.to_pylist(), strict=True)} == {"the": 2, "lazy": 2, "dog": 2}
    assert not words.full() and [len(x) for x in words.taken()] == [0, 0]


def test_the_table_of_words_is_hashed_in_parts():
    """The driver makes it: beside the table itself it takes some MB, however many words there are."""
    words = [f"{k:024}" for k in range(100_000)]
    rows = pa.table({"w": words, "n": pa.array(range(100_000), pa.int64()), "ids": pa.array([[k] for k in range(100_000)], pa.list_(pa.int32()))})
    tracemalloc.start()
    table = P.Frequent(rows)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 64e6, most
    text = np.frombuffer("".join(words[::7]).encode("utf-32-le"), np.uint32)
    at = np.arange(0, len(text), 24)
    assert (table.find(P._hashes(text, at, at + 24)) == 99_999 - np.arange(0, 100_000, 7)).all()
