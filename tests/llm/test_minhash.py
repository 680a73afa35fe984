import random

import pytest

from linecue.llm import minhash
from linecue.llm.common import table
from linecue.llm.components import components


def shingle_set(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs that share a shingle."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for j in {j for x in s for j in where.get(x, ())}:
            if 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                parent[root(i)] = root(j)
        for x in s:
            where.setdefault(x, []).append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(sets[i]), least[root(i)], least[root(i)] == d) for i, (d, _) in enumerate(rows))


def corpus(seed):
    """Groups of near copies around a base that is itself absent from some, with looser ones among them."""
    rand, rows = random.Random(seed), []
    vocabulary = [f"W{i}é" for i in range(300)]
    for group in range(12):
        base = [rand.choice(vocabulary) for _ in range(rand.randint(6, 120))]
        for _ in range(rand.randint(1, 25)):
            text = list(base)
            for _ in range(rand.randint(0, 1 + len(base) // 25)):
                text[rand.randrange(len(text))] = rand.choice(vocabulary)
            rows.append(" ".join(text) if rand.random() < 0.7 else "\n".join(text).lower())
    rows += ["", None, " \t\n", "one", "ONE", "one two three", "one two  three", "a b c d", "x " * 4000, "x " * 9000]
    rand.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed, block", [(1, minhash.BLOCK_SHINGLES), (2, 150)])
def test_equals_all_pairs(spark, monkeypatch, seed, block):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, set_id string, band int").repartition(3)
    assert sorted(map(tuple, minhash.near_duplicates(docs).drop("row").collect())) == brute(rows)


def test_equal_ids_null_ids_and_empty_table(spark):
    schema = "doc_id long, text string"
    rows = [(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (5, "p q r s t"), (None, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, schema)).drop("row").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(5, 2, 5, True)] * 3 + [(None, 2, 5, False), (None, 0, None, False)], key=str)
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_repeated_rows_make_one_set_a_class(spark, monkeypatch):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join([*base[:-1], "end"])]
    docs = spark.createDataFrame([(5, texts[i % 2]) for i in range(600)] + [(None, " ".join([*base, "more"]))], "doc_id long, text string")
    made, sets = [], minhash._sets

    def counted(*args):
        made.append(sets(*args))
        return made[-1]

    monkeypatch.setattr(minhash, "_sets", counted)
    got = minhash.near_duplicates(docs).collect()
    assert made[0].count() == 3 and len(got) == 601 and {r.component_id for r in got} == {5}


def test_bands_of_unlike_texts(spark):
    rand = random.Random(9)
    common = [f"c{i}" for i in range(70)]
    rows = [(i, " ".join([*common, *(f"u{rand.randrange(10**6)}" for _ in range(45))])) for i in range(120)]
    rows += [(200 + i, rows[i][1] + " x") for i in range(20)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).drop("row").collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i + 1, i) for i in range(100, 140)] + [(7, i) for i in range(8, 40)] + [(3, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 7 for i in range(7, 40)}}


def test_query_equals_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert sorted(map(tuple, minhash.op7_minhash(spark, sf).collect())) == brute(rows)
