import hashlib
import random
import zlib

import numpy as np
import pytest

from linecue.llm import runs
from tests.llm.oracle import same_as_duckdb


def brute(words, times=runs.TIMES, least=runs.LEAST):
    """Every maximal stretch of every period, tried one by one."""
    found, n = {}, len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b, q) for (a, b), q in found.items())


def told(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    gone = {i for a, b, q in found for i in range(a + q, b)}
    best = min(found, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    first = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    digest = lambda s: hashlib.sha256(s).hexdigest()
    lines = "".join(f"{a},{b - a},{q}\n" for a, b, q in sorted(found, key=lambda r: (r[0], r[2])))
    return doc_id, len(found), *first, digest(lines.encode()), digest(b" ".join(w for i, w in enumerate(words) if i not in gone))


@pytest.mark.parametrize("seed", range(60))
def test_runs_equal_brute_force(seed):
    rand = random.Random(seed)
    texts = []
    for _ in range(rand.randint(1, 6)):
        words = [rand.randint(0, rand.choice([1, 2, 40])) for _ in range(rand.randint(0, 60))]
        for _ in range(rand.randint(0, 3)):
            part = [rand.randint(0, 3) for _ in range(rand.randint(1, 7))]
            words += (part * rand.randint(2, 9))[: rand.randint(1, 60)] + [rand.randint(0, 3)] * rand.randint(0, 2)
        texts.append(words)
    times, least = rand.choice([(4, 6), (4, 6), (2, 2), (3, 5)])
    starts = np.cumsum([0, *map(len, texts)])
    want = [(a + s, b + s, q) for t, s in zip(texts, starts) for a, b, q in brute(t, times, least)]
    got = runs.runs(np.array([w for t in texts for w in t], np.int64), np.repeat(np.arange(len(texts)), [len(t) for t in texts]), times, least)
    assert [tuple(r) for r in got.tolist()] == sorted(want)


def test_leaves_listed_in_steps(monkeypatch):
    monkeypatch.setattr(runs, "AT_ONCE", 3)
    words = [1, 2, 3] * 20 + [5] * 9 + [1, 2, 3, 1] * 5
    assert [tuple(r) for r in runs.runs(np.array(words), np.zeros(len(words), np.int64)).tolist()] == brute(words)


ODD = ["", None, " \n\t", "one", "a a a a a a", "a a a a a", "a a a a a a a a", "x y " * 4, "x y " * 3, "x\ty\x0bx\x0cy\rx\ny x y é", "w " * 1500, "A a A a A a A a", "b " * 9 + "c " * 9, "p q r s " * 300 + "p q"]


def test_odd_texts(spark):
    rows = [(i % 40 or None, t) for i, t in enumerate(ODD * 9)]
    docs = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "doc_id long, text string, start int, words string, `N_RUNS` double").repartition(3)
    got = [tuple(r) for r in runs.periodic_runs(docs, runs.repeating_tail).collect()]
    told_of = {r: told(*r) for r in set(rows)}
    assert sorted(got, key=repr) == sorted(map(told_of.get, rows), key=repr)


def test_empty_table(spark):
    assert runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = sorted(tuple(r) for r in runs.op13_periodic_runs(spark, sf).collect())
    assert got == sorted(told(r.doc_id, r.text) for r in docs)
    assert sum(r[1] > 0 for r in got) > len(got) // 20


def test_query_equals_sql(spark):
    same_as_duckdb(runs.op13_periodic_runs, runs.ORACLE, spark, "/root/testdata/sf0.01")
