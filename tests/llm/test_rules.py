import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa

from cairn.llm import rules, subjects


def test_patterns_against_counting(spark):
    rng = random.Random(5)
    sets = Counter((tuple(sorted(rng.sample(range(12), rng.randint(0, 6)))), rng.randint(-1, 2)) for _ in range(400))
    want = defaultdict(lambda: [0.0] * 4)
    for (items, c), n in sets.items():
        for size in (1, 2, 3):
            for part in combinations(items, size):
                want[part][3] += n
                if c >= 0:
                    want[part][c] += n
    want = {k: v for k, v in want.items() if v[3] >= 5}
    rows = list(zip(*rules.conditional(sets, 4)))
    df = spark.createDataFrame([(s, list(i), c, float(n)) for s, i, c, n in rows], "shard int, items array<bigint>, class int, n double").repartition(3)
    got = [(tuple(r["items"]), r["counts"]) for r in rules.frequent(df, 3, 4, 5, 3).collect()]
    assert len(got) == len(want) and dict(got) == want and len(got) > 100


def test_redundant_rules_are_pruned(spark):
    rows = [([1], 0, 0.5), ([2], 1, 0.4), ([1, 2], 0, 0.9), ([3], 0, 0.85), ([1, 3], 0, 0.9), ([1, 2, 3], 0, 0.95), ([4, 5], 1, 0.3)]
    df = spark.createDataFrame(rows, "items array<bigint>, class int, confidence double")
    assert sorted(r["items"] for r in rules.needed(df, 0.1).collect()) == [[1], [1, 2], [2], [3], [4, 5]]
    assert rules.needed(df.limit(0), 0.1).count() == 0


def test_surest_rule_of_sentences_against_brute_force():
    rng = random.Random(6)
    known = {}
    for _ in range(300):
        known[tuple(sorted(rng.sample(range(1, 40), rng.choice([1, 2, 2, 3, 3]))))] = (rng.randrange(3), round(rng.random(), 6))
    table = pa.table({"items": pa.array([list(k) for k in known], pa.list_(pa.int64())), "class": pa.array([c for c, _ in known.values()], pa.int32()), "confidence": [p for _, p in known.values()]})
    mined = subjects.Rules.of(table, 3)
    sentences = [rng.sample(range(1, 40), rng.randint(0, 9)) for _ in range(500)]
    got = mined.surest(np.array([i for s in sentences for i in s], dtype=np.int64), np.array([len(s) for s in sentences]))
    want = [max((round(p * 1e9) * 3 + c for k, (c, p) in known.items() if set(k) <= set(s)), default=-1) for s in sentences]
    assert got.tolist() == want
    none = subjects.Rules.of(table.slice(0, 0), 3)
    assert none.surest(np.array([1, 2], dtype=np.int64), np.array([2, 0])).tolist() == [-1, -1]
