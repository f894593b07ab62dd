"""What the fourth round's findings asked for."""

import numpy as np
import pytest

from dialoglens.llm import compact_windows, jaccard_join
from dialoglens.llm.storage import Scratch


def families(s: compact_windows.Settings, groups: int, size: int) -> tuple[np.ndarray, ...]:
    """Groups of members whose surroundings are mixed from others': whole, moved by some places, with places changed."""
    rng, width = np.random.default_rng(7), 2 * s.reach + 1
    every, keys, docs = [], [], []
    for g in range(groups):
        own = []
        for i in range(size):
            row = rng.integers(1, 1 << 16, width)
            if i > 2 and rng.random() < 0.7:
                for part in (slice(0, s.reach), slice(s.reach, width)):
                    row[part] = own[rng.integers(i)][part]
                if rng.random() < 0.4:
                    row = np.roll(row, rng.integers(1, 4))
                row[rng.integers(0, width, rng.integers(0, 14))] = rng.integers(1, 1 << 16)
            if rng.random() < 0.2:
                row[: rng.integers(0, s.reach - 10)] = 0
            row[s.reach] = 7
            own.append(row)
        every += own
        keys += [g] * size
        docs += sorted(rng.integers(0, size, size).tolist())
    return np.array(keys, np.uint64), np.array(docs), np.array(every).astype(np.uint16)


def test_sources_are_those_of_all_pairs_without_all_pairs(monkeypatch):
    """Members that lacked a source met every smaller member of their group, so that time went with its square."""
    s = compact_windows.Settings(rounds=4)
    keys, doc, context = families(s, 3, 150)
    group = keys.astype(np.int64)
    todo, _ = compact_windows.shared_passages(group, doc, context, s)
    a, b = np.nonzero((group[:, None] == group) & (doc[:, None] < doc))
    want, all_pairs = todo.copy(), len(a)
    good = compact_windows.repeated(a, b, context, s, todo)
    for i in np.flatnonzero(good.any(axis=1)):
        want[b[i]] &= ~good[i]
    held, real = [], compact_windows.repeated
    monkeypatch.setattr(compact_windows, "repeated", lambda x, *more: held.append(len(x)) or real(x, *more))
    # with values shared by chance everywhere, every passage seems to have a source
    for first in (todo, np.ones_like(todo)):
        held.clear()
        left = first.copy()
        hits = [(x, y) for p, q in compact_windows.sourced(keys, doc, context, s, left) for x, y in zip(p.tolist(), q.tolist(), strict=True)]
        assert (left & todo == want).all() and hits
        assert sum(held) < all_pairs / 5


@pytest.mark.parametrize("call", [jaccard_join.jaccard_join, compact_windows.repeated_passages])
def test_no_stage_keeps_two_python_workers_a_task(spark, monkeypatch, call):
    """Texts were filtered by one Python worker and taken apart by another of the same task, so an executor held twice as many."""
    plans, real = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(self, df, name))
    text = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "other words of a text"), (None, text)], "doc_id long, text string")
    found = call(docs).collect()
    assert {2} <= {r["doc_id"] for r in found} and not any("ArrowEvalPython" in p for p in plans)
