import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from linecue.llm import token_files
from linecue.llm.common import shared_path, table
from linecue.llm.wavelet import BLOCK_BITS, WaveletFile, build

MODEL = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", " a", "a ", "a  b", "a\n b", "a \n b", "a\n\n b", "x\x1c y \x1cz \x85 q", "<|endoftext|>", "a <|endoftext|> b", "  lead", "a　b 　 c", "it's we'll", "é" * 3000, "\t\ta\r\n  \r\n b"]


@pytest.mark.parametrize("n, high", [(0, 1), (1, 1), (7, 2), (300, 50257), (2 * BLOCK_BITS + 13, 70000)])
def test_wavelet_file_answers_like_the_list(n, high):
    ids = np.random.default_rng(n).integers(0, high, n)
    file = WaveletFile(build(ids, [5, None], np.array([0, n // 2, n])))
    assert file.decode().tolist() == ids.tolist() and file.doc_ids == [5, None]
    for i in list(range(min(n, 5))) + ([n - 1] if n else []):
        v = int(ids[i])
        where = np.flatnonzero(ids == v)
        assert file.access(i) == v
        assert file.count(v) == len(where) and file.rank(v, i) == (where < i).sum()
        assert file.count(v, i, n) == (where >= i).sum()
        assert file.occurrences(v)[:50] == where.tolist()[:50]
    assert file.count(high + 5) == 0 and file.select(0, n + 1) == -1
    with pytest.raises(IndexError):
        file.access(n)


def want(rows):
    tokenizer = Tokenizer.from_file(MODEL)
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("sizes", [{}, {"shard_ids": 40, "task_bytes": 2000}])
def test_odd_texts(spark, sizes):
    rows = [*enumerate(ODD), (50, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows[::-1]], "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, token_files.documents_of_files(docs, MODEL, **sizes).collect()))
    assert got == want(rows)


def test_equal_and_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "b"), (None, "c")], "doc_id long, text string")
    got = sorted(map(tuple, token_files.documents_of_files(docs, MODEL).select("start", "n_tokens").collect()))
    assert got == [(0, 2), (2, 2), (4, 2)]
    assert token_files.documents_of_files(docs.where("false"), MODEL).count() == 0


def test_ids_read_back(spark):
    docs = spark.createDataFrame([(1, "some words here"), (2, "")], "doc_id long, text string")
    path = shared_path(spark, "test")
    token_files.write(docs, path, MODEL)
    tokenizer = Tokenizer.from_file(MODEL)
    got = {r.doc_id: r.ids for r in token_files.read(spark, path).collect()}
    assert got == {1: [*tokenizer.encode("some words here").ids, 0], 2: [0]}


def test_query_equals_the_library(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in table(spark, sf, "documents").collect())
    assert sorted(map(tuple, token_files.op6_token_files(spark, sf).collect())) == want(rows)
