"""Quality classifier: a byte-level convolutional network in numpy.

Filters look at WIDTH bytes from every position of a text; as each byte has
one row of weights for each place in the filter, a convolution is WIDTH table
look-ups. Positions are grouped into chunks of CHUNK, which overlap by the
filter's width, so that no window is missed; each chunk keeps the largest
answer of every filter, a text keeps the mean and the maximum over its chunks,
and a logistic layer makes one probability of them.

Learning happens on the driver on at most SAMPLE labelled rows (the first by a
hash of doc_id), which is a parameter; it reads their texts whole. Scoring reads
every byte of every text.

Cases: a null or empty text is one chunk without bytes and gets the network's
score for it; labels of a doc_id are averaged, null ones ignored; without
labels, or with labels of one kind, every score is the share of label 1 (0.5
if there is none); rows of equal or null doc_id are scored one by one, a null
doc_id is never learned from; an empty table gives an empty table; further
columns are passed on, one named as the score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from linecue.llm.common import slices, table

WIDTH, FILTERS, CHUNK = 5, 16, 512
#: Bound of what the driver learns from: labelled rows.
SAMPLE = 2000
#: Chunks that one step of learning looks at at once.
AT_ONCE = 256
STEPS, BATCH = 400, 32
FOLDS = 5
LEAST_SCORE = 0.3


@dataclass
class Network:
    """tables: (WIDTH, 256, FILTERS); bias: (FILTERS,); out: weights of means, then maxima, then the constant."""

    tables: np.ndarray
    bias: np.ndarray
    out: np.ndarray

    def pooled(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The largest answers in each chunk; data ends with WIDTH - 1 bytes of padding, chunks begin at starts."""
        n, best = len(data) - WIDTH + 1, np.full((len(starts), FILTERS), -np.inf, np.float32)
        size = 64 * CHUNK
        for a in range(0, n, size):
            b = min(n, a + size)
            answer = self.tables[0][data[a:b]]
            for k in range(1, WIDTH):
                answer += np.take(self.tables[k], data[a + k : b + k], axis=0)
            first = max(0, int(np.searchsorted(starts, a, side="right")) - 1)
            last = int(np.searchsorted(starts, b, side="left"))
            cuts = np.maximum(starts[first:last], a) - a
            np.maximum(best[first:last], np.maximum.reduceat(answer, cuts, axis=0), out=best[first:last])
        return np.maximum(best + self.bias, 0)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The probability of each text."""
        if not texts:
            return np.empty(0)
        lengths = np.maximum([len(t) for t in texts], 1)
        data = np.frombuffer(b"".join(t.ljust(n, b"\0") + b"\0" * (WIDTH - 1) for t, n in zip(texts, lengths, strict=True)), np.uint8)
        counts = -(-lengths // CHUNK)
        begins = np.cumsum(lengths + WIDTH - 1) - lengths - WIDTH + 1
        # Windows that begin in the padding reach into the next text: they are a chunk of their own, which is dropped.
        starts = np.repeat(begins - (np.cumsum(counts + 1) - counts - 1) * CHUNK, counts + 1) + np.arange((counts + 1).sum()) * CHUNK
        last = np.cumsum(counts + 1) - 1
        starts[last] = begins + lengths
        chunks = np.delete(self.pooled(np.concatenate([data, np.zeros(WIDTH - 1, np.uint8)]), starts), last, axis=0)
        firsts = np.cumsum(counts) - counts
        means = np.add.reduceat(chunks, firsts, axis=0) / counts[:, None]
        return 1 / (1 + np.exp(-(np.hstack([means, np.maximum.reduceat(chunks, firsts, axis=0)]) @ self.out[:-1] + self.out[-1])))


def learn(samples: list[tuple[list[bytes], float]], steps: int = STEPS, seed: int = 7) -> Network:
    """A network from (chunks of a text, label) rows: Adam on the logistic loss; the maxima pass their gradient to the bytes that won."""
    rand = np.random.default_rng(seed)
    net = Network(*(x.astype(np.float32) for x in (rand.normal(0, 0.3, (WIDTH, 256, FILTERS)), np.zeros(FILTERS), np.append(rand.normal(0, 0.3, 2 * FILTERS), 0))))
    params = [net.tables, net.bias, net.out]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    filters = np.arange(FILTERS)
    for step in range(1, steps + 1):
        rows = [samples[i] for i in rand.integers(0, len(samples), BATCH)]
        counts = np.array([len(c) for c, _ in rows])
        firsts, labels = np.cumsum(counts) - counts, np.array([y for _, y in rows])
        data = np.frombuffer(b"".join(c.ljust(CHUNK + WIDTH - 1, b"\0") for cs, _ in rows for c in cs), np.uint8).reshape(-1, CHUNK + WIDTH - 1)
        places, tops = [], []
        for part in np.split(data, range(AT_ONCE, len(data), AT_ONCE)):
            answer = net.tables[0][part[:, :CHUNK]]
            for k in range(1, WIDTH):
                answer += net.tables[k][part[:, k : k + CHUNK]]
            places.append(answer.argmax(axis=1))
            tops.append(np.take_along_axis(answer, places[-1][:, None], axis=1)[:, 0])
        place, chunks = np.concatenate(places), np.maximum(np.concatenate(tops) + net.bias, 0)
        means, tops = np.add.reduceat(chunks, firsts, axis=0) / counts[:, None], np.maximum.reduceat(chunks, firsts, axis=0)
        x = np.hstack([means, tops])
        error = (1 / (1 + np.exp(-(x @ net.out[:-1] + net.out[-1]))) - labels) / BATCH
        back = error[:, None] * net.out[None, :-1]
        of = np.repeat(np.arange(BATCH), counts)
        grad = (back[:, :FILTERS] / counts[:, None])[of] + back[of, FILTERS:] * (chunks == tops[of])
        grad = grad * (chunks > 0)
        tables = np.zeros_like(net.tables)
        for k in range(WIDTH):
            hit = np.take_along_axis(data, place + k, axis=1).astype(np.int64) * FILTERS + filters
            tables[k] = np.bincount(hit.ravel(), grad.ravel(), 256 * FILTERS).reshape(256, FILTERS)
        for p, g, m, v in zip(params, [tables, grad.sum(axis=0), np.append(error @ x, error.sum())], first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.03 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def held_out(key: Column) -> Column:
    """True for the fold that is never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def chunks_of(text: str | None) -> list[bytes]:
    """A text's chunks, each with the bytes of the next one that its last windows reach into."""
    data = (text or "").encode()
    return [data[i : i + CHUNK + WIDTH - 1] for i in range(0, max(len(data), 1), CHUNK)]


def labelled(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> list[tuple[list[bytes], float]]:
    """At most `most` rows to learn from, outside the held-out fold; the same ones whatever the partitioning."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg(label).alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").select("text", "label")
    found = rows.orderBy(F.xxhash64("text"), "label").limit(most).collect()
    return [(chunks_of(r.text), r.label) for r in found]


def fit(docs: DataFrame, labels: DataFrame, **bounds) -> Network | float:
    """The network, or one score for all where the labels can't teach one."""
    samples = labelled(docs, labels, **bounds)
    kinds = {y for _, y in samples}
    return learn(samples) if len(kinds) > 1 else kinds.pop() if kinds else 0.5


def score(docs: DataFrame, model: Network | float, name: str = "score") -> DataFrame:
    """docs with the score under that name."""
    at = docs.columns.index("text")
    # Columns go through Python by their place, so that no name can clash.
    placed = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, f"c{at}"):
            texts = [(t or "").encode() for t in batch.column(at).to_pylist()]
            found = np.full(len(texts), model) if isinstance(model, float) else model.scores(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, "score"])

    found = placed.mapInArrow(run, StructType([*placed.schema.fields, StructField("score", DoubleType())]))
    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() != name.lower()), F.col("score").alias(name))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))
