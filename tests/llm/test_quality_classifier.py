import zlib

import numpy as np
import pytest

from linecue.llm import quality_classifier as qc
from linecue.llm.common import table

SF = "/root/testdata/sf0.01"


def plain_score(net, text):
    """One text, window by window."""
    n = max(len(text), 1)
    data = text.ljust(n, b"\0") + b"\0" * (qc.WIDTH - 1)
    chunks = []
    for start in range(0, n, qc.CHUNK):
        seen = [sum(net.tables[k][data[p + k]] for k in range(qc.WIDTH)) for p in range(start, min(start + qc.CHUNK, n))]
        chunks.append(np.maximum(np.max(seen, axis=0) + net.bias, 0))
    x = np.hstack([np.mean(chunks, axis=0), np.max(chunks, axis=0)])
    return 1 / (1 + np.exp(-(x @ net.out[:-1] + net.out[-1])))


def test_scores_equal_a_plain_loop_alone_and_together():
    rand = np.random.default_rng(1)
    net = qc.Network(*(rand.normal(0, 1, s).astype(np.float32) for s in ((qc.WIDTH, 256, qc.FILTERS), qc.FILTERS, 2 * qc.FILTERS + 1)))
    texts = [b"", b"a", b"abcd", bytes(rand.integers(0, 256, 512, np.uint8)), bytes(rand.integers(0, 256, 1025, np.uint8)), b"z" * 40_000, bytes(rand.integers(97, 123, 33_000, np.uint8))]
    together = net.scores(texts)
    assert np.allclose(together, [plain_score(net, t) for t in texts], atol=1e-5)
    assert np.allclose(together, [net.scores([t])[0] for t in texts], atol=1e-6)


def test_held_out_accuracy(spark):
    rows = qc.op4_quality_classifier(spark, SF).join(table(spark, SF, "labels"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert np.mean([r.predicted for r in rows if r.quality == 1]) > 0.99


@pytest.mark.parametrize("labels, want", [([], 0.5), ([(1, 1), (2, 1), (3, None)], 1.0), ([(2, 0)], 0.0)])
def test_labels_that_teach_nothing(spark, labels, want):
    docs = spark.createDataFrame([(1, "a"), (2, ""), (None, None)], "doc_id long, text string")
    model = qc.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert [r.score for r in qc.score(docs, model).collect()] == [want] * 3


def test_odd_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(i, "good words here " * i, 1) for i in range(30)] + [(100 + i, "%% ## " * i, 1) for i in range(30)] + [(None, None, 1), (7, "x", 1)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(100 + i, 0) for i in range(30)], "doc_id long, quality int")
    model = qc.fit(docs, labels)
    rows = qc.score(docs, model).collect()
    assert len(rows) == 62 and all(0 <= r.score <= 1 for r in rows)
    assert qc.score(docs.where("false"), model).count() == 0
    assert [r.score for r in qc.score(docs.repartition(1), qc.fit(docs.repartition(5), labels)).orderBy("doc_id").collect()] == [r.score for r in qc.score(docs, model).orderBy("doc_id").collect()]
