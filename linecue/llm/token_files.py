"""Token ids of every document in wavelet files, one a shard, written and read back by Spark tasks.

Documents are dealt by ranges of their id, so that shard after shard holds
them in ascending order; rows of equal id follow a hash of their text, null
ids come first. A task writes a file for every `shard_ids` ids, under a name
that only its place gives: a task that runs again writes the same file again.

Cases: a null text counts as empty and gives the end id alone; an empty table
gives no file and no rows; a text longer than a shard has a file of its own;
further columns are not read.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linecue.llm.chunk_table import ChunkTable, chunks_of_texts, list_array
from linecue.llm.common import checkpointed, shared_path, slices, table
from linecue.llm.wavelet import WaveletFile, build

#: Ids of one file at most (but a document is never split).
SHARD_IDS = 4_000_000
#: Before the first chunk of a text in the table, as no space stands before it in the text; chunks start with it in no other way.
FIRST = " "
#: Text bytes that one task encodes.
TASK_BYTES = 32 << 20


#: A space that no character other than white space follows.
_LOOSE = re.compile(r" (?:\s|$)")


def is_plain(text: str) -> bool:
    """True if a character other than white space follows every space."""
    return _LOOSE.search(text) is None


def chunks_of(text: str) -> list[str]:
    """Cuts before each space that a character other than white space follows; chunks without that space.

    The tokenizer's own cuts always include these, whatever stands around
    them, so the chunks can be encoded alone.
    """
    return re.split(r" (?=\S)", text)


@functools.lru_cache(maxsize=4)
def chunk_table(model: str) -> ChunkTable:
    """The table of this worker, kept from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(model)
    return ChunkTable(functools.partial(_encode_chunks, tokenizer), most=1_500_000)


#: Letters that every version of Unicode knows: one run of them after a space is one word for the model.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


@functools.lru_cache(maxsize=1)
def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: a character for each byte, printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


def _encode_chunks(tokenizer, new: list[str]) -> list[list[int]]:
    """Ids of distinct chunks; those that are one word go to the tokenizer's model at once, which is its costly part."""
    from tokenizers import pre_tokenizers

    cut, model = tokenizer.pre_tokenizer, tokenizer.model
    direct = tokenizer.normalizer is None and isinstance(cut, pre_tokenizers.ByteLevel) and cut.use_regex
    words = [direct and _LETTERS.fullmatch(c) is not None for c in new]
    rest = iter(tokenizer.encode_batch([c[1:] if c[:1] == FIRST else " " + c for c, w in zip(new, words, strict=True) if not w], add_special_tokens=False))
    letters = _byte_letters()
    return [[t.id for t in model.tokenize((" " + c).encode().decode("latin-1").translate(letters))] if w else next(rest).ids for c, w in zip(new, words, strict=True)]


def encode_texts(chunks: ChunkTable, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
    cut, counts = chunks_of_texts(texts, is_plain, chunks_of)
    starts = (np.cumsum(counts) - counts)[counts > 0]
    return chunks.ids_of(cut, counts, end_id, [FIRST + c for c in cut.take(pa.array(starts)).to_pylist()])


def write(docs: DataFrame, path: str, model: str, end_id: int = 0, shard_ids: int = SHARD_IDS, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Writes the files below `path`; returns (part, seq, n_ids, n_docs) of each file, already computed."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(max(1, -(-total // task_bytes)), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        task, chunks, seq = TaskContext.get(), chunk_table(model), 0
        ids, doc_ids, counts = [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal seq
            flat, starts = np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))])
            name = f"{folder}/part-{task.partitionId():06d}-{seq:05d}.wm"
            with store.open_output_stream(f"{name}.{task.taskAttemptId()}.tmp") as out:
                out.write(build(flat, doc_ids, starts, part=task.partitionId(), seq=seq))
            store.move(f"{name}.{task.taskAttemptId()}.tmp", name)
            made = pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_ids": [len(flat)], "n_docs": [len(doc_ids)]})
            seq += 1
            ids.clear(), doc_ids.clear(), counts.clear()
            return made

        for batch in slices(batches, most=8 << 20):
            found, offsets = encode_texts(chunks, batch.column(1).to_pylist(), end_id)
            ids.append(found)
            doc_ids.extend(batch.column(0).to_pylist())
            counts.append(np.diff(offsets))
            if sum(map(len, ids)) >= shard_ids:
                yield flush()
        if ids:
            yield flush()

    return checkpointed(rows.mapInArrow(run, "part int, seq int, n_ids long, n_docs long"))


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents of the files: part, seq, doc_id, first (position in the file), n_tokens, ids_crc32[, ids]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                file = WaveletFile(data.as_py())
                ids, starts = file.decode().astype("<u4"), file.starts
                n = len(file.doc_ids)
                columns = {
                    "part": pa.array([file.about["part"]] * n, pa.int32()),
                    "seq": pa.array([file.about["seq"]] * n, pa.int32()),
                    "doc_id": pa.array(file.doc_ids, pa.int64()),
                    "first": pa.array(starts[:-1]),
                    "n_tokens": pa.array(np.diff(starts)),
                    "ids_crc32": pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:], strict=True)], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = list_array(ids.astype(np.int32), starts)
                yield pa.RecordBatch.from_pydict(columns)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(path).select("content")
    return files.mapInArrow(run, "part int, seq int, doc_id long, first long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def shard_starts(files: DataFrame) -> DataFrame:
    """Ids of all files before each one; a row a file, so small."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("part", "seq", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"))


def documents_of_files(docs: DataFrame, model: str, **sizes) -> DataFrame:
    """Writes the documents' ids and reads them back with their place among all ids."""
    spark = docs.sparkSession
    path = shared_path(spark, "token-files")
    files = write(docs, path, model, **sizes)
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    found = read(spark, path, with_ids=False).join(shard_starts(files), ["part", "seq"])
    return found.select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, count and checksum of every document's ids, read from the wavelet files."""
    import public_tokenizers

    return documents_of_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
