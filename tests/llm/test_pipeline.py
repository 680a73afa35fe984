import hashlib

import corpus_pipeline
from linecue.llm import quality_classifier as qc
from linecue.llm import quality_rules as qr
from linecue.llm.common import table
from tests.llm import test_decontaminate, test_quality_rules, test_sentencepieces
from tests.llm.test_minhash import shingle_set

SF = "/root/testdata/sf0.001"


def near_groups(rows, width=5):
    """Smallest ids of the components of similarity 0.8 or more, by comparing all pairs."""
    sets, parent = [shingle_set(t, width) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return set(least.values())


def brute(spark, sf_dir):
    """What each stage keeps, then the digests, in plain Python; only the network is learned by the operator."""
    docs = table(spark, sf_dir, "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    model = qc.fit(docs, table(spark, sf_dir, "labels"))
    scores = model.scores([(t or "").encode() for _, t in rows])
    kept = [[r for r, s in zip(rows, scores, strict=True) if s >= qc.LEAST_SCORE]]
    trusted = {r.doc_id for r in table(spark, sf_dir, "labels").collect() if r.quality == 1}
    sums = {d: (s, n) for d, s, n in test_quality_rules.brute(kept[0], trusted)}
    passes = lambda d, t: (x := test_quality_rules.statistics(t))[0] >= 50 and 100 * x[4] <= 50 * x[0] and sums[d][0] >= round(qr.LEAST_SCORE * 1e6) * sums[d][1]
    kept.append([(d, t) for d, t in kept[0] if passes(d, t)])
    stays = near_groups(kept[1])
    kept.append([(d, t) for d, t in kept[1] if d in stays])
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    bad = {d for d, _ in test_decontaminate.brute([r for r in kept[2]], items)}
    kept.append([(d, t) for d, t in kept[2] if d not in bad])
    ids, texts = test_sentencepieces.library([t or "" for _, t in kept[3]])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return kept, sorted((d, len(i), sha(" ".join(map(str, i))), sha(x)) for (d, _), i, x in zip(kept[3], ids, texts, strict=True))


def test_run_equals_plain_python(spark):
    kept, want = brute(spark, SF)
    counts = list(map(len, kept))
    assert counts == sorted(counts, reverse=True) and counts[3] > 50
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == want


def test_stages_keep_the_columns_and_stand_odd_rows(spark):
    docs = table(spark, SF, "documents")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        assert stage(spark, docs.limit(30), SF).columns == docs.columns, k
        assert stage(spark, docs.where("false"), SF).count() == 0
    good = docs.where("doc_id = 0")
    odd = good.union(good).union(good.selectExpr("cast(null as bigint)", "text", "lang", "source", "n_chars")).union(good.selectExpr("9999", "cast(null as string)", "lang", "source", "n_chars"))
    assert [r.doc_id for r in corpus_pipeline.without_near_duplicates(spark, odd, SF).orderBy("doc_id").collect()] == [0, 9999]
    assert corpus_pipeline.encoded(spark, odd, SF).count() == 4


def test_columns_of_any_name_and_repeated_items(spark):
    names = "score words lines windows kept n_words base_failed row doc key whole component_id text_ c0".split()
    docs = table(spark, SF, "documents")
    docs = docs.selectExpr("doc_id", "text", *(f"concat('{n}', doc_id) AS {n}" for n in names)).limit(60)
    docs = docs.union(docs.limit(1)).union(docs.limit(1).selectExpr("cast(null AS bigint)", *docs.columns[1:]))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and kept.count() > 10, k
        assert kept.exceptAll(docs).count() == 0
        assert all(r[n] == f"{n}{r.doc_id}" for r in kept.where("doc_id is not null").collect() for n in names)


def test_rows_of_one_id_and_rows_without_id_are_documents(spark):
    one, two, three = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = one.replace("a59", "z")
    rows = [(1, one), (5, near), (5, two), (5, two), (None, three), (None, three + " end"), (None, one), (7, None)]
    item = table(spark, SF, "benchmark").where("item_id = 0").first().text
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.without_near_duplicates(spark, docs, SF).collect()
    assert sorted((r.doc_id, (r.text or "-")[0]) for r in got if r.doc_id) == [(1, "a"), (5, "b"), (7, "-")]
    assert [r.text[:2] for r in got if r.doc_id is None] == ["c0"]
    leaky = spark.createDataFrame([(1, one), (1, item), (None, item), (None, two)], "doc_id long, text string")
    assert sorted(map(tuple, corpus_pipeline.without_benchmark(spark, leaky, SF).collect()), key=str) == sorted([(1, one), (None, two)], key=str)
