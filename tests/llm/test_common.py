import numpy as np
from pyspark.sql import functions as F

from shardflow.llm.common import filtered_by, gram_hashes, hash_filter, hash_spans, in_filter


def test_filters_miss_no_key(spark):
    keys = spark.range(60_000).select(F.xxhash64("id").alias("k"))
    found = hash_filter(keys)
    held, others = (spark.range(a, a + 60_000).select(F.xxhash64("id").alias("k")) for a in (0, 10**6))
    assert filtered_by(held, "k", found).count() == 60_000 and filtered_by(held, "k", found, keep=False).count() == 0
    assert filtered_by(others, "k", found).count() < 600
    assert in_filter(found, np.array([r["k"] for r in keys.limit(10).collect()])).all()
    assert not in_filter(hash_filter(keys.limit(0)), np.arange(1000, dtype=np.int64) << 40).any()


def test_a_filter_of_many_parts_is_few_jobs(spark):
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    keys, before = spark.range(1 << 20).select(F.xxhash64("id").alias("k")), jobs()
    found = hash_filter(keys)
    assert len(found) == 1 << 21 and jobs() - before < 10
    assert filtered_by(keys, "k", found).count() == 1 << 20


def test_grams_hash_as_spans_of_equal_bytes_do():
    data = np.frombuffer(b"abcdefgh_abcdefgh", np.uint8)
    grams = gram_hashes(data, 8)
    assert grams[0] == grams[9] and len(set(grams.tolist())) == len(grams) - 1 and len(gram_hashes(data[:3], 8)) == 0
    assert hash_spans(data, np.array([0, 9]), np.array([8, 17])).tolist()[0] == hash_spans(data, np.array([9]), np.array([17]))[0]


def test_hashing_takes_little_memory_beside_the_texts():
    import tracemalloc

    import pyarrow as pa

    from shardflow.llm.common import texts_of, word_hashes

    texts = pa.array([f"word{k} and some more words " * 80 for k in range(2000)])
    tracemalloc.start()
    try:
        n = sum(len(word_hashes(data, offsets)[0]) for _, data, offsets in texts_of(texts))
        assert tracemalloc.get_traced_memory()[1] < 40 << 20  # powers of hashes are kept
    finally:
        tracemalloc.stop()
    assert n == 2000 * 80 * 5
