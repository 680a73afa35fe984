"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

Shingle sets are sets of 64-bit hashes. A first permutation (multiplication by
an odd number and an xor, then the high digits) scatters a shingle over a
circle of 2^20 places; the second permutation is one table over that circle.
Coordinate k of a signature is the least table entry k places after the
shingles' places: the table is shifted circularly, so two permutations give
all coordinates, and the entries of one shingle lie side by side in memory.

Documents of equal sets are one class and are compared once. Classes that
share a band are compared with the least class of that band; then the classes
of a band that are not yet in one component are compared in blocks of bounded
size, by their rarest shingles first, so that no pair that shares a band stays
unknown. Every link comes from the exact size of the intersection of full sets.
With 32 bands of 5 coordinates, a pair of similarity 0.8 would share no band
with probability 3e-6 if coordinates were independent; circulant ones are not
quite, and the README has the recall as measured.

Cases: null texts, empty texts and texts without words have an empty set and
link with nothing; rows of equal doc_id are separate rows, and rows repeated as
a whole are read once where sets are compared; a null doc_id keeps its row and
never is a component's id unless all are null; an empty table gives an empty
table; further columns are not read, whatever their names. A text of any
length has one set; its signature is made in blocks.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linecue.llm.chunk_table import list_array
from linecue.llm.common import checkpointed, document, joined_apart, slices, table
from linecue.llm.components import components

WIDTH, BANDS, ROWS = 4, 32, 5
#: Similarity of a link, in hundredths.
LEAST_PERCENT = 80
CIRCLE_BITS = 20
#: Shingles that one block of a comparison holds, about.
BLOCK_SHINGLES = 400_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.array([0xD6E8FEB86659FD93], np.uint64)[0]


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word `width`-grams; all words as one shingle if there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - width + 1
    out = h[:n].copy()
    for k in range(1, width):
        out = out * _STEP + h[k : k + n]
    out ^= out >> np.uint64(29)
    return np.unique(out * _ODD)


@functools.lru_cache(maxsize=2)
def _windows(coordinates: int) -> np.ndarray:
    """Row p: the second permutation's entries at the places p, p + 1, ... of the circle."""
    size = 1 << CIRCLE_BITS
    entries = np.random.default_rng(20240601).permutation(size).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([entries, entries[:coordinates]]), coordinates)


def signature(hashes: np.ndarray, coordinates: int) -> np.ndarray:
    """The least entry of every coordinate over a set that isn't empty."""
    places = ((hashes ^ (hashes >> np.uint64(32))) * _ODD) >> np.uint64(64 - CIRCLE_BITS)
    windows = _windows(coordinates)
    least = np.full(coordinates, np.iinfo(np.int32).max, np.int32)
    for i in range(0, len(places), 1024):
        np.minimum(least, windows[places[i : i + 1024]].min(axis=0), out=least)
    return least


def band_keys(sign: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for every band, with the band's number in it."""
    parts = sign.reshape(bands, -1)
    return np.array([xxhash.xxh3_64_intdigest(p.tobytes(), seed=b) for b, p in enumerate(parts)], np.uint64).view(np.int64)


def signed(docs: DataFrame, key: str, width: int, bands: int, rows: int) -> DataFrame:
    """(doc, set_id, n_shingles, keys): set_id is a digest of the whole set, null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t, width) for t in batch.column(1).to_pylist()]
            keys = [band_keys(signature(s, bands * rows), bands) if len(s) else np.empty(0, np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    list_array(np.concatenate(keys), np.concatenate([[0], np.cumsum([len(k) for k in keys])])),
                ],
                names=["doc", "set_id", "n_shingles", "keys"],
            )

    rows_in = docs.select(document(key).alias("doc"), F.col("text").cast("string").alias("text"))
    return rows_in.mapInArrow(run, f"doc {rows_in.schema['doc'].dataType.simpleString()}, set_id binary, n_shingles long, keys array<long>")


def _sets(docs: DataFrame, key: str, wanted: DataFrame, width: int) -> DataFrame:
    """(set_id, hashes) of the wanted classes (set_id, doc), from the text of that document; one row a class, however often a row is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [(i, shingles(t, width)) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            sets = [(i, s) for i, s in sets if xxhash.xxh3_128_digest(s.tobytes()) == i]  # another text may have the same hash
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in sets], pa.binary()), list_array(np.concatenate([s for _, s in sets]).view(np.int64), np.concatenate([[0], np.cumsum([len(s) for _, s in sets])]))], names=["set_id", "hashes"])

    texts = docs.select(document(key).alias("doc"), F.col("text").cast("string").alias("text")).join(wanted.hint("merge"), "doc")
    return texts.select("set_id", "text").mapInArrow(run, "set_id binary, hashes array<long>").dropDuplicates(["set_id"])


def _linked(a: int, b: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


def _verify_pairs(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ha, hb) whose sets are similar enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [_linked(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)), percent) for x, y in zip(batch.ha, batch.hb, strict=True)]
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    return pairs.mapInPandas(run, "a binary, b binary")


def _least_common(size: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set shares with every set it may be linked with, at least."""
    return -(-percent * size // 100)


def _links_in_block(percent: int):
    """Links between the asking and the other classes of a block that are not yet in one component; a forest of them.

    Two linked sets share a shingle among the rarest of either, so only classes
    that do are compared, and of these only ones in different components.
    """

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["asks", "set_id"])
        sizes = block.hashes.map(len).to_numpy()
        _, ids = np.unique(np.concatenate(block.hashes.to_list()), return_inverse=True)
        counts = np.bincount(ids)
        order = np.empty(len(counts), np.int64)
        order[np.argsort(counts, kind="stable")] = np.arange(len(counts))
        first = np.concatenate([[0], np.cumsum(sizes)])
        rare = [np.sort(order[ids[a:b]])[: b - a - least + 1] for a, b, least in zip(first[:-1], first[1:], _least_common(sizes, percent), strict=True)]
        asks, label, names = block.asks.to_numpy(), block.label.to_numpy(), block.set_id.to_numpy()
        others = np.flatnonzero(~asks)
        owners = np.repeat(others, [len(rare[j]) for j in others])
        known = np.concatenate([rare[j] for j in others]) if len(others) else np.empty(0, np.int64)
        by_shingle = np.argsort(known, kind="stable")
        known, owners = known[by_shingle], owners[by_shingle]
        marked, parent, found = np.zeros(len(counts), np.int64), {x: x for x in label}, []

        def root(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for i in np.flatnonzero(asks):
            begin, end = np.searchsorted(known, rare[i], "left"), np.searchsorted(known, rare[i], "right")
            near = np.unique(np.concatenate([owners[a:b] for a, b in zip(begin, end, strict=True)]))
            own = ids[first[i] : first[i + 1]]
            marked[own] = 1
            for j in near[(100 * np.minimum(sizes[near], sizes[i]) >= percent * np.maximum(sizes[near], sizes[i]))]:
                if names[j] == names[i] or (x := root(label[i])) == (y := root(label[j])):
                    continue
                if _linked(sizes[i], sizes[j], int(marked[ids[first[j] : first[j + 1]]].sum()), percent):
                    parent[x] = y
                    found.append((names[i], names[j]))
            marked[own] = 0
        return pd.DataFrame(found, columns=["a", "b"])

    return run


def links(docs: DataFrame, key: str, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Verified links (a, b) between classes of sets that share a band, enough of them to connect all that is connected.

    classes: set_id, doc, n_shingles, keys; one row a class.
    """
    rows = classes.select(F.explode("keys").alias("band"), "set_id", "n_shingles")
    shared = rows.groupBy("band").agg(F.min(F.struct("set_id", "n_shingles")).alias("low"), F.max("set_id").alias("most"))
    shared = shared.where("low.set_id <> most").select("band", F.col("low.set_id").alias("least"), F.col("low.n_shingles").alias("least_n"))
    rows = checkpointed(joined_apart(rows, shared, "band"))
    ids = rows.select("set_id").distinct()
    sets = checkpointed(_sets(docs, key, classes.join(ids, "set_id", "left_semi").select("doc", "set_id"), width))

    near = F.least("least_n", "n_shingles") * 100 >= percent * F.greatest("least_n", "n_shingles")
    pairs = rows.where("set_id <> least").where(near).select(F.col("least").alias("a"), F.col("set_id").alias("b")).distinct()
    left, right = (sets.select(F.col("set_id").alias(x), F.col("hashes").alias(f"h{x}")) for x in "ab")
    star = checkpointed(_verify_pairs(pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "hb"), percent))

    labels = components(star)
    rest = rows.where("set_id <> least").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").select("band", "set_id", "n_shingles", F.coalesce("component", "set_id").alias("label"))
    rest = checkpointed(rest)
    by_label = rest.groupBy("band", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"), F.sum(F.xxhash64("set_id").cast("decimal(38,0)")).alias("x"))
    mixed = by_label.groupBy("band").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels"), F.sum("n").alias("n"), F.sum("s").alias("all_s"), F.sum("x").alias("x"), F.max("n").alias("main_n"), F.max_by("s", F.struct("n", "label")).alias("main_s")).where("labels > 1")
    once = mixed.groupBy("n", "x").agg(F.min("band").alias("band"))  # bands of the same classes are one question
    mixed = mixed.join(once.select("band"), "band", "left_semi").select("band", "main", blocks_of("all_s").alias("all_blocks"), blocks_of("all_s - main_s").alias("ask_blocks"))
    members = rest.join(mixed, "band")
    place = lambda n, salt: F.pmod(F.xxhash64("set_id", F.lit(salt)), F.col(n)).cast("int")
    asking = members.where("label <> main").select("band", "set_id", "label", F.lit(True).alias("asks"), place("ask_blocks", 1).alias("p"), F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("q"))
    others = members.select("band", "set_id", "label", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("ask_blocks") - 1)).alias("p"), place("all_blocks", 2).alias("q"))
    more = asking.union(others).join(sets, "set_id").groupBy("band", "p", "q").applyInPandas(_links_in_block(percent), "a binary, b binary")
    return star.union(more)


def blocks_of(amount: str) -> Column:
    """Number of blocks for that many shingles."""
    return F.expr(f"cast(1 + ({amount}) div {BLOCK_SHINGLES} as int)")


def near_duplicates(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, percent: int = LEAST_PERCENT, key: str = "doc_id") -> DataFrame:
    """(key, row, n_shingles, component_id, kept) for every row; row: the text's hash, as common.document has it."""
    found = checkpointed(signed(docs, key, width, bands, rows))
    named = found.where("set_id is not null").groupBy("set_id").agg(F.min("doc").alias("doc"), F.min(f"doc.{key}").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"))
    classes = checkpointed(named)
    linked = components(links(docs, key, classes, width, percent)).withColumnRenamed("node", "set_id")
    named = classes.select("set_id", "least").join(linked, "set_id", "left").select("set_id", "least", F.coalesce("component", "set_id").alias("component"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = joined_apart(named, ids, "component").select("set_id", "component_id")
    out = found.select("doc", "n_shingles", "set_id").join(named, "set_id", "left")
    own = F.col(f"doc.{key}")
    component = F.when(F.col("set_id").isNull(), own).otherwise(F.col("component_id"))
    return out.select(own.alias(key), "doc.row", "n_shingles", component.alias("component_id"), F.coalesce(own == component, F.lit(False)).alias("kept"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near duplicates of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("row")
