"""Quality rules with adaptive thresholds, in DataFrame functions only.

Every whole text is measured.  KLL quantile sketches of each measure are made for each (language, source) and
merged to sketches for each language and for all rows; a group's thresholds are fences around its quartiles,
taken from its own sketch if it has ``min_group`` rows, else from its language's, else from that of all rows.
Most texts have no symbols or repeats at all, so that quartiles of such shares are 0 and say nothing of how far a
group's texts differ; their rules look at log((count + c) / (size + 2 c)) with a small constant c, whose quartiles
are apart wherever lengths differ.
The rows are joined with their group's fences and those outside any of them are rejected.  Sketches merge in
partial aggregates, so a source with a third of all rows costs one sketch a task; the thresholds are one row a
group and reach the rows by a join on (language, source) whose large groups Spark can split.

Null and empty texts have no words: all measures are 0 and the base rule rejects them.  Null languages and
sources are groups of their own.  Texts that fail the base rule stay out of the sketches.  Ties and repeated
rows are measured alike; other columns are kept, and results replace columns of the same name, and names
that begin with an underscore are taken.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardflow.llm.common import stored

_WHITE = r"[\x20\x09-\x0D]+"
_MARKS = "#*$%&|<>"
#: Rules whose fences decide: whether low values count, what is added to a count before the logarithm (lines are few,
#: so less), and the quartile distance that is taken where a group's texts don't differ.
RULES = {
    "word_length": {"low": True, "guard": 0.1},
    "symbols": {"low": False, "added": 0.5, "guard": 0.25},
    "dup_lines": {"low": False, "added": 0.1, "guard": 0.25},
    "repeats": {"low": False, "added": 0.5, "guard": 0.25},
}


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_words", F.filter(F.split(t, _WHITE, -1), lambda w: w != ""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0)
    out = out.withColumn("_lines", lines).withColumn("_n", F.size("_words"))
    # hashes of 3-word windows; those found twice are few, and windows are looked at again only where there are any
    out = out.withColumn("_w", F.expr("CASE WHEN _n >= 3 THEN transform(sequence(0, _n - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])) ELSE array() END"))
    out = out.withColumn("_again", F.expr("size(_w) > size(array_distinct(_w))"))
    # windows as (hash, position) in order: those of a run of two or more equal hashes count, from the first on
    runs = """CASE WHEN _again THEN array_sort(transform(_w, (h, i) -> struct(h, i))) ELSE array() END"""
    out = out.withColumn("_s", F.expr(runs))
    at = """array_sort(transform(filter(transform(_s, (s, i) -> struct(s.i AS at,
        (i > 0 AND _s[greatest(i - 1, 0)].h = s.h) OR (i + 1 < size(_s) AND _s[least(i + 1, size(_s) - 1)].h = s.h) AS twice)),
        x -> x.twice), x -> x.at))"""
    out = out.withColumn("_at", F.expr(f"CASE WHEN _again THEN {at} ELSE array() END"))
    covered = "transform(_at, (p, i) -> CASE WHEN i = 0 THEN 3 ELSE least(3, p - _at[greatest(i - 1, 0)]) END)"
    measures = F.struct(
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, _MARKS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"CAST(aggregate({covered}, 0, (a, x) -> a + x) AS BIGINT)").alias("n_repeat_words"),
        F.size("_lines").alias("_n_lines"),
    )
    # as the row of a generator: later filters on a measure then look at its value and don't compute it again
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return out.select(*kept, F.inline(F.array(measures)))


def _values() -> dict[str, Column]:
    """What each rule of ``RULES`` looks at."""
    parts = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "_n_lines"), "repeats": ("n_repeat_words", "n_words")}
    out = {"word_length": F.col("word_chars") / F.greatest("n_words", F.lit(1))}
    for rule, (count, size) in parts.items():
        added = RULES[rule]["added"]
        out[rule] = F.log((F.col(count) + F.lit(added)) / (F.col(size) + F.lit(2 * added)))
    return out


def thresholds(measured: DataFrame, lang: str, source: str, min_group: int, width: float, k: int) -> DataFrame:
    """A row for each (lang, source) with the fences of each rule, from mergeable sketches."""
    sketches = [F.kll_sketch_agg_double(F.col(r), F.lit(k)).alias(r) for r in RULES]
    by_source = measured.groupBy(F.col(lang).alias("_lang"), F.col(source).alias("_source")).agg(F.count("*").alias("n"), *sketches)

    def merged(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(r, F.lit(k)).alias(r) for r in RULES])

    def fences(df: DataFrame, prefix: str) -> DataFrame:
        out = [F.col("n").alias(f"{prefix}n")]
        for r, rule in RULES.items():
            quarter = [F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double(r, F.lit(q))) for q in (0.25, 0.75)]  # no rows, no sketch
            room = width * F.greatest(quarter[1] - quarter[0], F.lit(rule["guard"]))
            out += [(quarter[1] + room).alias(f"{prefix}{r}_high")] + ([(quarter[0] - room).alias(f"{prefix}{r}_low")] if rule["low"] else [])
        return df.select(*[c for c in ("_lang", "_source") if c in df.columns], *out)

    by_source = stored(by_source, "quality-sketches")
    by_lang = merged(by_source, "_lang")
    own, language = fences(by_source, "s_"), fences(by_lang, "l_").withColumnRenamed("_lang", "_l")
    everything = fences(merged(by_lang), "").first().asDict()  # one row of a few numbers
    joined = own.join(language, F.col("_lang").eqNullSafe(F.col("_l")))
    names = [c for c in everything if c != "n"]
    pick = lambda c: F.when(F.col("s_n") >= min_group, F.col(f"s_{c}")).when(F.col("l_n") >= min_group, F.col(f"l_{c}")).otherwise(F.lit(everything[c]).cast("double"))
    return joined.select("_lang", "_source", *[pick(c).alias(f"_{c}") for c in names])


def filter_quality(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_words: int = 50, max_repeat_percent: int = 50, min_group: int = 200, width: float = 3.0, k: int = 200, keep_text: bool = True
) -> DataFrame:
    """Add the measures, base_failed and kept.

    ``width``: the fences stand so many quartile distances outside the quartiles; k: the size of a sketch.
    Without ``keep_text`` the result has no text, and texts are measured once instead of twice.
    """
    measured = measure(docs, text) if keep_text else stored(measure(docs, text).drop(text), "quality-measures")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    measured = measured.withColumns({"base_failed": failed, **{f"_{r}": c for r, c in _values().items()}})
    limits = thresholds(measured.filter(~F.col("base_failed")).withColumns({r: F.col(f"_{r}") for r in RULES}), lang, source, min_group, width, k)
    inside = F.lit(True)
    for r, rule in RULES.items():
        inside &= F.col(f"_{r}") <= F.coalesce(F.col(f"_{r}_high"), F.lit(float("inf")))
        if rule["low"]:
            inside &= F.col(f"_{r}") >= F.coalesce(F.col(f"_{r}_low"), F.lit(float("-inf")))
    joined = measured.join(limits, F.col(lang).eqNullSafe(F.col("_lang")) & F.col(source).eqNullSafe(F.col("_source")), "left")
    joined = joined.withColumn("kept", ~F.col("base_failed") & inside)
    return joined.drop("_n_lines", *[f"_{r}" for r in RULES], *limits.columns)
