"""Distinct-chunk table: each distinct chunk of text is segmented once, ids are joined back by position."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class ChunkTable(dict):
    """chunk -> row number; the ids of all rows lie end to end in one array.

    `encode` gets a list of distinct chunks and returns their id lists. The
    table starts again when it holds more than `most` chunks, so a task's
    memory does not depend on how many chunks its rows have.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = 1_000_000):
        super().__init__()
        self.encode, self.most = encode, most
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.ids = np.empty(0, np.int32)
        self.ends = np.zeros(1, np.int32)

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.new.append(chunk)
        return n

    def segment_new(self) -> None:
        if self.new:
            found = self.encode(self.new)
            counts = np.fromiter(map(len, found), np.int64, len(found))
            self.ids = np.concatenate([self.ids, np.fromiter((x for ids in found for x in ids), np.int32, int(counts.sum()))])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts, dtype=np.int32)])
            self.new = []

    def rows(self, chunks: Iterable[str], n: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, chunks), np.int64, n)

    def ids_of(self, chunks: pa.Array, counts: np.ndarray, end_id: int, firsts: list[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, each text followed by end_id; offsets of the texts).

        chunks: of all texts end to end; counts: how many each text has;
        firsts: what stands in the table for the first chunk of each text that
        has one, if not the chunk itself.
        """
        if len(self) > self.most:
            self.restart()
        coded = chunks.dictionary_encode()
        rows = self.rows(coded.dictionary.to_pylist(), len(coded.dictionary))[coded.indices.to_numpy()] if len(chunks) else np.empty(0, np.int64)
        ends = np.cumsum(counts)
        if firsts is not None:
            rows[(ends - counts)[counts > 0]] = self.rows(firsts, len(firsts))
        self.segment_new()
        rows = np.insert(rows, ends, len(self.ends) - 1)  # the row behind the last is the end id
        begins, values = np.append(self.ends, self.ends[-1] + 1), np.append(self.ids, np.int32(end_id))
        first = begins[rows]
        sizes = begins[rows + 1] - first
        upto = np.cumsum(sizes, dtype=np.int32)
        places = np.repeat(first - upto + sizes, sizes)
        places += np.arange(len(places), dtype=np.int32)
        return values[places], np.concatenate([[0], upto[ends + np.arange(len(counts))]])


def chunks_of_texts(texts: list[str], plain: Callable[[str], bool], cut: Callable[[str], list[str]]) -> tuple[pa.Array, np.ndarray]:
    """Chunks of all texts end to end, and how many each has: `plain` texts are cut at each space, the others by `cut`."""
    found, counts, k = [pa.array([], pa.string())], [], 0
    simple = [plain(t) for t in texts]
    while k < len(texts):
        if not simple[k]:
            chunks = cut(texts[k])
            found.append(pa.array(chunks, pa.string()))
            counts.append(np.array([len(chunks)]))
            k += 1
            continue
        end = next((j for j in range(k, len(texts)) if not simple[j]), len(texts))
        parts = pc.split_pattern(pa.array(texts[k:end], pa.string()), " ")
        found.append(parts.flatten())
        counts.append(parts.value_lengths().to_numpy())
        k = end
    return pa.concat_arrays(found), np.concatenate(counts) if counts else np.empty(0, np.int64)


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
