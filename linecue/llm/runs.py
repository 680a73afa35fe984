"""Periodic runs of words: Stoye and Gusfield's search for branching tandem repeats in a suffix tree, texts dealt out by Spark.

A run is a stretch of consecutive words with smallest period q that no
neighbouring word extends keeping it, TIMES * q and LEAST words long at least.
Each word of a run occurs TIMES times in it, so words that are rarer in their
stretch of a text are cut out first, again and again; the rest of a slice of
texts, its stretches apart by marks that occur once, gets one suffix tree. It
stands as sorted suffixes with their common prefixes: a boundary between two
neighbours is an inner node of the binary form of the tree, its depth their
common prefix, its leaves the suffixes up to the next shallower boundary. The
leaves of the smaller half of each node are listed: p and p + depth on either
side of it make a tandem repeat that the next word doesn't continue. Repeats
are rotated to the left as far as words agree, which gives whole runs; those
with one start and end are one run, of the smallest period.

Common prefixes and rotations are read from ranks of blocks of 2 ** k words,
kept for each k. Memory is that of one slice: 8 * log2(longest repeat) bytes a
word that is left, of SLICE_BYTES of text or of one longer text.

Cases: a null or empty text has no word and no run; rows of equal or null
doc_id are texts of their own; an empty table gives an empty table; further
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linecue.llm.common import slices, table

TIMES, LEAST = 4, 6
#: Leaves that one step lists.
AT_ONCE = 1 << 20
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
Change = Callable[[int | None, list[bytes]], list[bytes]]


def repeated_part(ids: np.ndarray, stretch: np.ndarray, times: int, least: int) -> np.ndarray:
    """Places of the words that can lie in a run; stretch: ascending numbers of the texts."""
    at = np.arange(len(ids))
    while len(at):
        _, back, counts = np.unique(stretch * np.int64(ids.max() + 1) + ids, return_inverse=True, return_counts=True)
        keep = counts[back] >= times
        before = len(at)
        at, ids, stretch = at[keep], ids[keep], stretch[keep]
        stretch = np.cumsum((np.diff(at, prepend=-2) > 1) | (np.diff(stretch, prepend=-1) > 0)) - 1
        long = np.bincount(stretch)[stretch] >= least if len(at) else keep[:0]
        at, ids, stretch = at[long], ids[long], stretch[long]
        if len(at) == before:
            break
    return at


def block_ranks(ids: np.ndarray) -> list[np.ndarray]:
    """For each k the rank of the 2 ** k words from each place on, until all differ; 0 stands for what is behind the end."""
    n, ranks = len(ids), [np.append(np.unique(ids, return_inverse=True)[1] + 1, 0)]
    while ranks[-1].max() < n:
        last, step = ranks[-1], 1 << (len(ranks) - 1)
        after = np.zeros(n, np.int64)
        after[: max(n - step, 0)] = last[step:n]
        ranks.append(np.append(np.unique(last[:n] * np.int64(n + 1) + after, return_inverse=True)[1] + 1, 0))
    return ranks


def common(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """Words that agree from a and b on, or before them."""
    n, length = len(ranks[0]) - 1, np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = (a - length - (1 << k), b - length - (1 << k)) if back else (a + length, b + length)
        inside = (x >= 0) & (y >= 0) & (x < n) & (y < n)
        same = inside & (ranks[k][np.where(inside, x, 0)] == ranks[k][np.where(inside, y, 0)])
        length += same.astype(np.int64) << k
    return length


def nodes(depths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) suffix below each boundary; boundary i stands between suffixes i and i + 1, of equal ones the first is above."""
    first, last, open_ = [0] * len(depths), [len(depths)] * len(depths), []
    for i, d in enumerate(depths.tolist()):
        while open_ and open_[-1][1] > d:
            last[open_.pop()[0]] = i
        first[i] = open_[-1][0] + 1 if open_ else 0
        open_.append((i, d))
    return np.array(first, np.int64), np.array(last, np.int64)


def branching_repeats(ids: np.ndarray, ranks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(place, half) of all tandem repeats of 2 * half words whose next word differs from the one half before it."""
    order = np.argsort(ranks[-1][:-1])
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    depths = common(ranks, order[:-1], order[1:])
    first, last = nodes(depths)
    inner = np.flatnonzero(depths)
    left, right = inner - first[inner] + 1, last[inner] - inner
    small, begin = np.minimum(left, right), np.where(left <= right, first[inner], inner + 1)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    parts = np.cumsum(small) // AT_ONCE
    for part in np.split(np.arange(len(inner)), np.flatnonzero(np.diff(parts)) + 1):
        node = np.repeat(part, small[part])
        leaf = order[begin[node] + np.arange(len(node)) - np.repeat(np.cumsum(small[part]) - small[part], small[part])]
        at, half = inner[node], depths[inner[node]]
        for way in (1, -1):
            other = leaf + way * half
            there = np.flatnonzero((other >= 0) & (other < len(ids)))
            rank, i = place[other[there]], at[there]
            on_left = begin[node[there]] <= i
            hit = there[np.where(on_left, (rank > i) & (rank <= last[i]), (rank >= first[i]) & (rank <= i))]
            found.append((np.minimum(leaf[hit], other[hit]), half[hit]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def runs(ids: np.ndarray, text: np.ndarray, times: int = TIMES, least: int = LEAST) -> np.ndarray:
    """(first word, word after the last, period) of all runs, ascending; ids and the ascending number of its text for each word."""
    at = repeated_part(ids, text, times, least)
    if not len(at):
        return np.empty((0, 3), np.int64)
    fresh = np.append(True, (np.diff(at) > 1) | (np.diff(text[at]) > 0))
    moved = np.cumsum(fresh) - 1 + np.arange(len(at))
    apart = -1 - np.arange(moved[-1] + 1)  # marks, of which none is like another
    apart[moved] = ids[at]
    origin = np.zeros(len(apart), np.int64)
    origin[moved] = at
    ranks = block_ranks(apart)
    where, half = branching_repeats(apart, ranks)
    start = where - common(ranks, where, where + half, back=True)
    length = where + 2 * half - start
    long = length >= np.maximum(least, times * half)
    found = np.stack([origin[start[long]], origin[start[long]] + length[long], half[long]], axis=1)
    found = np.unique(found, axis=0)
    return found[np.append(True, (found[1:, :2] != found[:-1, :2]).any(axis=1))[: len(found)]]


def _told(doc_id: int | None, words: list[bytes], found: np.ndarray) -> tuple:
    """The row of a text: its longest run and digests of all runs and of the text without their repetitions."""
    kept, best = words, (None,) * 4
    if len(found):
        gone = np.zeros(len(words) + 1, np.int64)
        np.add.at(gone, found[:, 0] + found[:, 2], 1)
        np.add.at(gone, found[:, 1], -1)
        kept = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
        start, end, period = min(found.tolist(), key=lambda r: (r[0] - r[1], r[0], r[2]))
        best = (start, end - start, period, 1000 * (end - start) // period)
    lines = "".join(f"{a},{b - a},{q}\n" for a, b, q in sorted(found.tolist(), key=lambda r: (r[0], r[2])))
    return doc_id, len(found), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def periodic_runs(docs: DataFrame, change: Change | None = None, times: int = TIMES, least: int = LEAST) -> DataFrame:
    """A row a document: number of runs, the longest one (smallest start and period among equals), digests of all and of the words that are no repetition.

    change: what becomes of a text's words before they are searched.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys = batch.column(0).to_pylist()
            texts = [(t or "").encode().split() for t in batch.column(1).to_pylist()]
            texts = [change(k, t) for k, t in zip(keys, texts, strict=True)] if change else texts
            known: dict[bytes, int] = {}
            ids = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), np.int64)
            ends = np.cumsum([len(t) for t in texts])
            found = runs(ids, np.repeat(np.arange(len(texts)), [len(t) for t in texts]), times, least)
            cuts = np.searchsorted(found[:, 0], ends)
            rows = []
            for i, (key, words) in enumerate(zip(keys, texts, strict=True)):
                own = found[cuts[i - 1] if i else 0 : cuts[i]]
                rows.append(_told(key, words, own - np.array([1, 1, 0]) * (ends[i] - len(words))))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if j > 5 else pa.int64()) for j, c in enumerate(zip(*rows, strict=True))], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def repeating_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of the documents, chosen by the CRC of the id, repeat from some word on with a period that the id gives."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, whose words repeating_tail changes first."""
    return periodic_runs(table(spark, sf_dir, "documents"), repeating_tail)


ORACLE = f"""WITH RECURSIVE
  docs AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
  crcs AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, n::BIGINT)) AS crc),
  hashed AS (
    SELECT rid, doc_id, words, len(words) AS n,
      xor(list_reduce(list_transform(range(length(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, (i + 1)::INTEGER, 1))::BIGINT), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h
    FROM docs, crcs),
  tails AS (SELECT *, (h // 10) % greatest(n, 1) AS a, 1 + (n - (h // 10) % greatest(n, 1)) // (3 + (h // 10) % 8) AS p FROM hashed),
  changed AS (SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: words[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE words END AS words FROM tails),
  placed AS (SELECT rid, n, unnest(words) AS w, unnest(range(n)) AS i FROM changed),
  -- A word of a run occurs {TIMES} times in it.
  often AS (SELECT rid, n, i, w FROM placed QUALIFY count(*) OVER (PARTITION BY rid, w) >= {TIMES}),
  same AS (SELECT x.rid, y.i - x.i AS q, x.i FROM often x JOIN often y ON x.rid = y.rid AND x.w = y.w AND y.i > x.i AND {TIMES} * (y.i - x.i) <= x.n),
  islands AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS g FROM same),
  kept AS (SELECT rid, min(i) AS s, max(i) + 1 + q AS e, q FROM islands GROUP BY rid, q, g HAVING count(*) + q >= greatest({LEAST}, {TIMES} * q)),
  runs AS (SELECT rid, s, e, min(q) AS q FROM kept GROUP BY rid, s, e),
  told AS (
    SELECT rid, count(*) AS n_runs, min_by({{'s': s, 'l': e - s, 'q': q}}, (s - e, s, q)) AS best, string_agg(concat(s, ',', e - s, ',', q, chr(10)), '' ORDER BY s, q) AS lines
    FROM runs GROUP BY rid),
  gone AS (SELECT DISTINCT rid, unnest(range(s + q, e)) AS i FROM runs),
  rest AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS text FROM placed ANTI JOIN gone USING (rid, i) WHERE rid IN (SELECT rid FROM runs) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s AS start, best.l AS length, best.q AS period, 1000 * best.l // best.q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(CASE WHEN n_runs IS NULL THEN array_to_string(words, ' ') ELSE text END, '')) AS collapsed_sha256
FROM changed LEFT JOIN told USING (rid) LEFT JOIN rest USING (rid)"""
