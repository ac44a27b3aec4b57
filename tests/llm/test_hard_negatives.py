"""Hard negatives against a plain computation over all rows, with ties, repeated and awkward rows."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from wardcast.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, block string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "b", 1) for r in rows], SCHEMA)


def mine(df, **more):
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, **more).collect()
    return sorted(map(tuple, got), key=str)


def plain(rows, k_pos=5, k_neg=10):
    """All rows against all anchors; rows keep their place, so repeated ids stay apart."""
    kept = [
        (i, id_, [math.floor(256 * x) for x in v], label)
        for i, (id_, v, label) in enumerate(rows)
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    best = lambda found: sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0, f[2]))
    out = []
    for i, id_, v, label in kept:
        if id_ is None or id_ % 10:
            continue
        scored = [(dot(v, w), other, j, lab) for j, other, w, lab in kept if j != i]
        for s, pid, _, _ in best([x for x in scored if x[3] == label])[:k_pos]:
            fits = best([x for x in scored if x[3] != label and 30 * s <= 100 * x[0] <= 90 * s])
            out += [(id_, pid, r, x[1], s, x[0]) for r, x in enumerate(fits[:k_neg], 1)]
    return sorted(out, key=str)


def test_equals_plain_scores(spark):
    draw = random.Random(11)
    rows = [(i, [draw.gauss(0.1, 0.5) for _ in range(19)], draw.randrange(3)) for i in range(300)]
    rows += [(i, [draw.choice([0.25, 0.5]) for _ in range(8)], 1) for i in range(300, 340)]  # many equal scores
    df = frame(spark, rows)
    assert mine(df) == plain(rows)
    assert mine(df.repartition(7), block=8, stripe=4) == plain(rows)


def test_awkward_rows(spark):
    v = [0.5, -0.25, 1.0]
    rows = [
        (0, v, 1), (0, v, 1), (1, v, 1), (None, [0.4, 0.0, 0.5], 2), (2, [0.3, 0.1, 0.6], 2), (3, None, 2), (4, v, None),
        (5, [None, 1.0, 1.0], 2), (6, [float("nan"), 0.1, 0.1], 2), (7, [float("inf"), 0.1, 0.1], 2), (8, [], 2), (10, [], 2),
        (9, [0.9, 0.0, 0.1, 5.0], 3), (20, [0.5], 3),
    ]
    assert mine(frame(spark, rows)) == plain(rows)
    assert mine(frame(spark, [])) == []
    assert mine(frame(spark, rows).filter("vec_id = 1")) == []


def test_scores_are_exact():
    draw = np.random.default_rng(3)
    for bits, dims in ((1, 5), (9, 64), (30, 17)):
        a, c = (draw.integers(-(1 << bits - 1), 1 << bits - 1, (n, dims)) for n in (6, 50))
        planes = hard_negatives.bit_planes(c, hard_negatives.digits(c))
        got = hard_negatives.scores(planes, hard_negatives.subset_sums(a, np.int64))
        assert (got == c @ a.T).all()
