import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from linecue.llm import sentencepieces
from linecue.llm.chunk_table import ChunkTable
from linecue.llm.common import table

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", " a", "a ", "a  b", "a\n b", "▁a ▁▁ b", "</s> <s>", "\x00 x", "héé 漢字 🙂", "x" * 5000, "   lots   of    room  ", "\t\ta\r\n", "<0x0A>", "a b 　c"]


def library(texts):
    processor = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = [processor.encode(t, add_eos=True) for t in texts]
    return ids, [processor.decode(i) for i in ids]


def test_equals_the_library_on_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(99, None, "x"), (99, None, "x")], "doc_id long, text string, ids string")
    got = {r.doc_id: (r.ids, r.decoded) for r in sentencepieces.encode(docs, MODEL, decoded=True).collect()}
    ids, decoded = library(ODD)
    assert got == {**{i: (x, y) for i, (x, y) in enumerate(zip(ids, decoded, strict=True))}, 99: ([2], "")}


def test_empty_table(spark):
    assert sentencepieces.encode(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0


def test_query_equals_the_library(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").collect()
    ids, decoded = library([d.text or "" for d in docs])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {d.doc_id: (len(i), sha(" ".join(map(str, i))), sha(x)) for d, i, x in zip(docs, ids, decoded, strict=True)}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in sentencepieces.op3_sentencepiece(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


@pytest.mark.parametrize("most", [1, 50])
def test_a_small_table_starts_again(most):
    small = ChunkTable(lambda new: [[len(c)] * len(c) for c in new], most=most)
    for _ in range(3):
        ids, offsets = small.ids_of(pa.array(["ab", "c", "c", "ab", "ddd"]), np.array([2, 0, 3]), 0)
        assert ids.tolist() == [2, 2, 1, 0, 0, 1, 2, 2, 3, 3, 3, 0] and offsets.tolist() == [0, 4, 5, 12]
