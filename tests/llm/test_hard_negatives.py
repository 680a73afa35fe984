import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from linecue.llm import hard_negatives as hn
from tests.llm.oracle import same_as_duckdb

SCHEMA = "vec_id long, embedding array<double>, label int, id string, size int, vec float, `range` int"


def brute(rows, anchor, positives=5, negatives=3, least=50, most=95):
    whole = lambda v: tuple(math.floor(max(-hn.LIMIT, min(hn.LIMIT, 256 * x))) for x in v)
    rows = {(r[0], r[2], whole(r[1])) for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1])}
    out = []
    for a in rows:
        if not anchor(a[0]):
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in rows if b[0] != a[0])
        for s, p, _ in [x for x in scored if x[2] == a[1]][:positives]:
            inside = [x for x in scored if x[2] != a[1] and least * -s <= 100 * -x[0] <= most * -s][:negatives]
            out += [(a[0], p, i + 1, n, -s, -m) for i, (m, n, _) in enumerate(inside)]
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1, 2.0, 3) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in hn.hard_negatives(hn.usable(df), F.col("id") % 3 == 0, **options).collect())


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK_ROWS", 7)
    monkeypatch.setattr(hn, "STEP", 5)
    rand = random.Random(seed)
    # Norms from small to large, many ties, two vectors that are everywhere.
    common = [[rand.gauss(0, 1) for _ in range(6)] for _ in range(2)]
    rows = [(i, rand.choice([*common, [rand.gauss(0, 1) * 10 ** rand.randint(-2, 1) for _ in range(6)]]), rand.randint(0, 2)) for i in range(120)]
    rows += rand.choices(rows, k=15)
    assert found(spark, rows, range_rows=rand.choice([10, 40, 1000])) == brute(rows, lambda i: i % 3 == 0)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0], 1), (3, [1.0, 0.9], 1), (4, [0.6, 0.6], 2), (5, [0.7], 2), (6, [], 1), (7, None, 1), (9, [1.0, nan], 1), (12, [inf, 1.0], 2), (15, [None, 1.0], 2), (None, [1.0, 1.0], 2), (18, [1.0, 1.0], None)]
    rows += [(21, [1e300, 1.0], 1), (22, [-1e300, 1.0], 2), (23, [0.5, 0.5, 0.5], 2), (3, [1.0, 0.9], 1), (3, [0.2, 0.9], 2), (24, [1e6, -1e6], 2), (27, [3e4] * 2, 1)]
    got = found(spark, rows)
    assert got == brute(rows, lambda i: i % 3 == 0) and got


def test_empty_table(spark):
    assert found(spark, []) == []


def test_short_vectors_are_not_multiplied():
    asked = pd.DataFrame({"id": [1], "label": [1], "vec": [[10, 0]], "size": [100], "lows": [[50, 400]], "highs": [[95, 500]]})
    rows = pd.DataFrame({"id": range(10, 1010), "label": 2, "vec": [[max(40 - i // 10, 1), 0] for i in range(1000)], "size": [max(40 - i // 10, 1) ** 2 for i in range(1000)]})
    best, made = hn.search(asked, rows, 3, False, step=10)
    assert [(w, s, i) for w, s, _, i in best.tolist()] == [(0, 90, 320), (0, 90, 321), (0, 90, 322), (1, 400, 10), (1, 400, 11), (1, 400, 12)]
    assert made == 320  # 31 buckets above 90 and the first at 90: then three are found, and 80 is less


def test_query_equals_sql(spark):
    same_as_duckdb(hn.op12_hard_negatives, hn.ORACLE, spark, "/root/testdata/sf0.01")
    same_as_duckdb(hn.op12_hard_negatives, hn.ORACLE, spark, "/root/testdata/sf0.1")
