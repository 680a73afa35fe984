"""SentencePiece encoding and decoding with a distinct-chunk table.

Text is cut before every run of word markers (the model's stand-in for a
space). A model none of whose pieces holds a marker after another character
never joins symbols across such a cut, so each chunk can be segmented alone.
`check_model` verifies this for the model in use; a model that fails it is
encoded text by text.

Cases: a null text counts as empty and gives the end id alone; an empty table
gives an empty table; repeated rows, repeated ids and null ids give one row
each; columns other than the id and the text are not read. Very long texts
are cut like all others; a slice of a batch holds at least one text.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linecue.llm.chunk_table import ChunkTable, chunks_of_texts, list_array
from linecue.llm.common import slices, table

MARK = "▁"
_RUNS = re.compile(f"{MARK}+[^{MARK}]*")


def check_model(processor) -> bool:
    """True if no piece holds a word marker after another character."""
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    return not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)


def is_plain(text: str) -> bool:
    """True if every marker of the text stands alone and before another character: cutting at each space is enough."""
    return bool(text) and "  " not in text and MARK not in text and text[0] != " " and text[-1] != " "


def chunks_of(text: str) -> list[str]:
    """Chunks without their first marker, which the library puts before any text."""
    return [c[1:] for c in _RUNS.findall(MARK + text.replace(" ", MARK))] if text else []


@functools.lru_cache(maxsize=4)
def _worker(model: str):
    """(processor, table, cutter) of this worker, kept from task to task."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=model)
    bare = processor.encode("a ")[len(processor.encode("a")) :]  # a marker with nothing after it; the library gives no ids for ""
    chunks = ChunkTable(lambda new: [ids if c else bare for c, ids in zip(new, processor.encode(new, num_threads=1), strict=True)])
    if check_model(processor):
        return processor, chunks, lambda texts: chunks_of_texts(texts, is_plain, chunks_of)
    return processor, chunks, lambda texts: chunks_of_texts(texts, lambda t: False, lambda t: [t] if t else [])


def encode(docs: DataFrame, model: str, text: str = "text", key: str = "doc_id", decoded: bool = False) -> DataFrame:
    """(key, ids array<int>[, decoded string]): ids of each whole text, then the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor, chunks, cut = _worker(model)
        for batch in slices(batches, "text"):
            ids, offsets = chunks.ids_of(*cut([t or "" for t in batch.column(1).to_pylist()]), processor.eos_id())
            columns = [batch.column(0), list_array(ids, offsets)]
            if decoded:
                columns.append(pa.array([processor.decode(ids[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["key", "ids", "decoded"][: len(columns)])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    found = rows.mapInArrow(run, "key long, ids array<int>" + ", decoded string" * decoded)
    return found.withColumnRenamed("key", key)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as counts and digests."""
    return digests(table(spark, sf_dir, "documents"))


def digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    found = encode(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded=True)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
