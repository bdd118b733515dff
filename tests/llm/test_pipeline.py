"""The pipeline against a plain version of each stage on a small corpus."""

import random

import pytest
import sentencepiece

import corpus_pipeline
from shardflow.llm.queries import PIECE_MODEL

from .conftest import WORDS
from .test_line_dedup import brute as plain_lines
from .test_ngram_join import brute as plain_classes


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    d = str(tmp_path_factory.mktemp("tables"))

    def prose(n):
        return " ".join(r.choice(WORDS) + str(r.randrange(300)) for _ in range(n))

    items = [(k, prose(25)) for k in range(5)]
    docs = [(k, prose(r.randrange(40, 120))) for k in range(80)]
    docs += [(100 + k, "%%% ### | " * 30) for k in range(40)]  # junk
    docs += [(200 + k, f"{docs[k][1]}\nThe same line everywhere") for k in range(15)]  # copies with a common line
    docs += [(300 + k, f"{prose(20)} {items[k][1]} {prose(20)}") for k in range(5)]
    docs += [(400, None), (401, "")]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    labels = [(i, int(not 100 <= i < 140), 0) for i, _ in docs if i % 2 == 0 and i < 400]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, dict(docs), items


def test_stages(spark, folder):
    d, texts, items = folder
    docs, columns = spark.read.parquet(f"{d}/documents.parquet"), None
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        columns = columns or docs.columns
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert not any(100 <= i < 140 for i in seen["quality"]) and set(range(80)) <= set(seen["quality"])
    ids = list(seen["quality"])
    left = plain_lines([seen["quality"][i] for i in ids], 10)
    assert {i: t or "" for i, t in seen["lines"].items()} == {i: "\n".join(x) for i, x in zip(ids, left, strict=True)}
    classes = plain_classes(list(seen["lines"].items()), 5, 80)
    assert set(seen["near"]) == {i for i, (_, c) in classes.items() if i == c}
    assert set(seen["near"]) - set(seen["benchmark"]) == {300 + k for k in range(len(items))}
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, d).collect()}
    assert got == {i: model.encode(t or "") for i, t in seen["benchmark"].items()}


def test_names_of_the_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near", "benchmark", "pieces"]


def test_rows_of_one_doc_id_lose_no_text(spark, folder):
    """Of (2, a), (4, a), (4, b), (9, b) a text stays for each of a and b; columns that clash are no matter."""
    a, b = " ".join(WORDS[:12]), " ".join(WORDS[12:])
    d = folder[0]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in [(2, a), (4, a), (4, b), (9, b)]], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near(spark, docs, d).collect()) == [(2, a), (4, b)]


def test_odd_tables(spark, folder, tmp_path):
    """Empty tables, long texts, repeated rows, null ids and texts, columns that clash with those of the stages."""
    import shutil

    d = str(tmp_path)
    for t in ("labels", "benchmark"):
        shutil.copytree(f"{folder[0]}/{t}.parquet", f"{d}/{t}.parquet")
    long = " ".join(WORDS[k % 24] + str(k) for k in range(20_000))
    rows = [(1, long, 1, 0.5), (2, long, 1, 0.5), (3, None, 1, 0.5), (4, "", 1, 0.5), (None, "x y z", 1, 0.5), (5, "again", 1, 0.5), (5, "again", 1, 0.5)]
    schema = "doc_id long, text string, N_Lines long, score double, kept string, ids int, n_chars long"
    df = spark.createDataFrame([(i, t, n, x, "clash", 7, 3) for i, t, n, x in rows], schema)
    for docs, want in ((df, 6), (df.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, d)
            assert docs.columns == df.columns
        assert want in (docs.filter("kept = 'clash' AND N_Lines = 1").count(), 0)
        assert corpus_pipeline.pieces(spark, docs, d).count() == docs.count()
