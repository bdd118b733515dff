import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, repeated rows and columns that clash with results."""
    import random

    r = random.Random(4)
    long = " ".join(r.choice(WORDS) + str(r.randrange(10_000)) for _ in range(60_000))
    rows = [
        (1, None, "en", None), (2, "", None, "a"), (3, " \t\n\n ", "en", "a"), (4, "one", "en", "a"), (4, "one", "en", "a"), (5, "x\x00y émigré\r\nUPPER lower", "fr", "b"),
        (6, long, "en", "a"), (7, long, "en", "a"), (None, "no id here at all", "en", "a"), (9, "日本語のテキスト 🙂🙂 ▁x", "ja", "b"), (10, "a" * 50_000, "en", "a"), (11, "  two  spaces   here ", None, None),
    ]
    rows = [(*x, -1, "clash", 0.5) for x in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_lines long, kept string, score double")
