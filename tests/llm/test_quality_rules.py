import math
import zlib
from collections import Counter

import pytest

from linecue.llm import quality_rules
from linecue.llm.common import table
from tests.llm.oracle import same_as_duckdb


def statistics(text):
    words = [w.decode() for w in (text or "").encode().split()]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(map(len, words)), sum(c in quality_rules.SYMBOLS for c in text or ""), len(lines) - len(set(lines)), len(covered)


ODD = ["", None, " \n\t", "one", "a b c a b c", "a a a a a", "x\ny\nx\n\n\n \n \nx ", "é # * 🙂 |\x0b<>\x0c", "\r\n".join(["l l"] * 9), " ".join(map(str, range(40))) * 3, "w " * 30000, "a b", "q\x00r \x1c s"]


def test_base_statistics(spark):
    docs = spark.createDataFrame([(i, t, "z", 1, 2) for i, t in enumerate(ODD)], "doc_id long, text string, n_words string, words long, `row` int")
    got = {r.doc_id: tuple(r)[2:] for r in quality_rules.base_statistics(docs).collect()}
    assert got == {i: statistics(t) for i, t in enumerate(ODD)}


def brute(rows, trusted):
    b, raw, aim, grams = quality_rules.n_buckets(sum(len((t or "").encode()) for _, t in rows)), Counter(), Counter(), []
    for d, t in rows:
        w = (t or "").encode().split()
        g = [zlib.crc32(x) % b for x in [*w, *(x + b" " + y for x, y in zip(w, w[1:]))]]
        raw.update(g)
        aim.update(g if d in trusted else [])
        grams.append(g)
    aims, raws = aim.total(), raw.total()
    weight = lambda k: round(1e6 * math.log(((aim[k] + 1.0) / (aims + b)) / ((raw[k] + 1.0) / (raws + b))))
    return [(d, sum(map(weight, g)), len(g)) for (d, _), g in zip(rows, grams)]


@pytest.mark.parametrize("trusted, inline, most", [([], 1 << 17, 1 << 21), ([2, 4, 11], 1 << 17, 1 << 21), ([2, 4, 11], 0, 1 << 21), ([2, 4, 11], 0, 0)])
def test_scores(spark, monkeypatch, trusted, inline, most):
    monkeypatch.setattr(quality_rules, "MOST_INLINE", inline)
    monkeypatch.setattr(quality_rules, "MOST_BROADCAST", most)
    monkeypatch.setattr(quality_rules, "MIN_BUCKETS", 16)
    rows = [*enumerate(ODD), (4, "a b c"), (4, "a b c a b c"), (4, "a b c a b c"), (None, "a b d"), (None, "a b d"), (None, None)]
    docs = spark.createDataFrame([(*r, 0, "x", True, 1.0, [1]) for r in rows], "doc_id long, text string, n_words int, words string, kept boolean, score double, windows array<int>")
    good = spark.createDataFrame([(d,) for d in [*trusted, None]], "doc_id long")
    got = [(r.doc_id, r.llr_sum, r.n_grams) for r in quality_rules.judge(docs, good).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, set(trusted)), key=str)


def test_buckets_grow_with_the_corpus():
    assert quality_rules.n_buckets(0) == quality_rules.n_buckets(1_000_000) == 1 << 14
    assert quality_rules.n_buckets(1 << 40) == 1 << 21 and quality_rules.n_buckets(10**14) == 1 << 24


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality_rules.judge(docs, docs.select("doc_id")).count() == 0


def test_query_equals_sql(spark):
    same_as_duckdb(quality_rules.op1_quality_rules, quality_rules.ORACLE, spark, "/root/testdata/sf0.01")


def test_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    judged = quality_rules.op1_quality_rules(spark, sf).where("not base_failed").join(table(spark, sf, "labels"), "doc_id").collect()
    assert all(r.kept for r in judged if r.quality == 1)
    assert sum(r.kept for r in judged if r.quality == 0) == 0
