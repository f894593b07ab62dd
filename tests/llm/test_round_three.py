"""What the third round's findings asked for."""

import numpy as np
from pyspark.sql import functions as F

from dialoglens.llm import compact_windows, mixing


def test_topics_are_fitted_on_all_texts(spark):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(400, mixing.DIMENSIONS)).astype(np.float32)
    df = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(rows)], "doc_id long, bag binary")
    mean = rows.astype(np.float64).mean(axis=0)
    first = df.select("doc_id", F.xxhash64(F.lit(17), "doc_id").alias("tie")).orderBy("tie").first()["doc_id"]
    every = rows - mean
    every /= np.linalg.norm(every, axis=1, keepdims=True)
    want = every[first : first + 1]
    while len(want) < 4:
        want = np.vstack([want, every[np.argmin((every @ want.T).max(axis=1))]])
    for _ in range(20):
        at = np.argmax(every @ want.T, axis=1)
        sums = np.stack([every[at == j].sum(axis=0) for j in range(4)])
        want = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    for parts in (1, 5):
        got = mixing.clusters(df.repartition(parts), mean, 4, 17)
        assert np.abs(got - want).max() < 1e-4
    assert not hasattr(mixing.DEFAULT, "sample")


def test_a_source_beyond_the_rounds_is_found(spark):
    s = compact_windows.Settings(rounds=2)
    rng = np.random.default_rng(5)
    context = rng.integers(1, 1 << 16, (10, 2 * s.reach + 1)).astype(np.uint16)
    context[:, s.reach] = 7
    context[9] = context[7]
    context[9, [s.reach - 1, s.reach + 1]] ^= 1
    keys, doc = np.full(10, 99, np.uint64), np.arange(10)
    todo, _ = compact_windows.shared_passages(np.zeros(10, np.int64), doc, context, s)
    found = [(a, b) for x, y in compact_windows.sourced(keys, doc, context, s, todo) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
    assert (7, 9) in found and not todo[9].any()
