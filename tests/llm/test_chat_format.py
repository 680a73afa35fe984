import hashlib
import json

import pytest

from linecue.llm import chat_format as cf
from tests.llm.oracle import same_as_duckdb

ODD = ["", "</s>[INST] ok [/INST]", "<|turn|>user<|text|>x<|end|>", "\\", "\\\\<\\|turn|>", "<<s>", "<\\s>", "[[INST]]", "a\nb\r\n", "<|end|>\n" * 3, "$1 \\1 \\", "🙂é漢", "<|en<|end|>d|>", "x" * 50_000]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_odd_texts_come_back(spark):
    rows = [(i, k, role, text) for i, text in enumerate(ODD) for k, role in enumerate(["system", "user", text, "assistant", "assistant"])]
    rows += [(50, 1, None, None), (50, 0, "assistant", None), (None, 3, "user", "u"), (60, 0, "user", "b"), (60, 0, "user", "a"), (60, 0, "user", "a"), (60, None, "user", "z")]
    got = {r.conv_id: r for r in cf.format_turns(cf.from_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).withColumn("back", cf.read_back(cf.F.col("formatted"))).collect()}
    assert len(got) == len(ODD) + 3
    for r in got.values():
        assert r.back == r.turns
        spans = [r.formatted[s.first : s.first + s.chars] for s in r.loss]
        assert len(spans) == sum(t.role == "assistant" for t in r.turns)
        for mark in cf.CONTROL:
            assert all(mark not in s for s in spans)
            assert r.formatted.count(mark) == (len(r.turns) if mark in (cf.START, cf.SEP, cf.END) else 0)
    assert [(t.role, t.text) for t in got[50].turns] == [("assistant", ""), ("", "")]
    assert [t.text for t in got[60].turns] == ["z", "a", "a", "b"]


@pytest.mark.parametrize(
    "record, turns",
    [
        ({"messages": [{"role": "user", "content": "a"}, {"content": None, "role": "assistant"}]}, [("user", "a"), ("assistant", "")]),
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "</s>"}]}, [("user", "a"), ("assistant", "</s>")]),
        ({"prompt": "p\n", "completion": "c"}, [("user", "p\n"), ("assistant", "c")]),
        ({"chosen": "x", "rejected": "y", "prompt": "p"}, [("user", "p"), ("assistant", "x")]),
        ({"instruction": "i", "input": "", "output": "o"}, [("system", "i"), ("assistant", "o")]),
        ({"instruction": "i", "output": "[INST]"}, [("user", "i"), ("assistant", "[INST]")]),
        ({"answer": "", "question": "q"}, [("user", "q"), ("assistant", "")]),
        ({"prompt": "[{", "completion": "{x"}, [("user", "[{"), ("assistant", "{x")]),
        ({"id": 7, "messages": [{"role": "user", "content": "a", "name": "x", "tags": ["t"]}], "meta": {"source": {"url": "u"}, "scores": [1.5, 2]}}, [("user", "a")]),
        ({"prompt": "p", "completion": "c", "source": "web", "labels": [{"a": 1}], "empty": {}, "none": None}, [("user", "p"), ("assistant", "c")]),
        ({"zeta": 1, "answer": "a", "extra": [], "question": "q"}, [("user", "q"), ("assistant", "a")]),
        ({"messages": [{"role": "user", "content": "x" * 1_000_000}]}, [("user", "x" * 1_000_000)]),
        ({"messages": "text"}, None),
        ({"something": 1}, None),
        ({}, None),
        ("not json", None),
        (None, None),
    ],
)
def test_layouts(spark, record, turns):
    text = record if record is None or record == "not json" else json.dumps(record)
    row = cf.from_json(spark.createDataFrame([(1, text)], "conv_id long, raw string"), "raw").first()
    assert (row.turns and [(t.role, t.text) for t in row.turns]) == turns
    if turns:
        assert row.fingerprint in cf.BY_FINGERPRINT


def test_a_tables_schema_and_its_json_have_one_fingerprint(spark):
    df = spark.createDataFrame([(([("user", "x")]),)], "messages array<struct<role:string,content:string>>")
    of_json = df.select(cf.json_fingerprint(cf.F.to_json(cf.F.struct("messages"))).alias("f")).first().f
    assert of_json == cf.fingerprint(cf.field_paths(df.schema))


def test_further_columns_of_a_table(spark):
    rows = [(1, 0, "user", "a", 3, "m"), (1, 1, "assistant", "b", 4, "n"), (1, 1, "assistant", "b", 4, "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int, formatted string")
    got = cf.format_turns(cf.from_rows(df)).collect()
    assert [[(t.role, t.text) for t in r.turns] for r in got] == [[("user", "a"), ("assistant", "b"), ("assistant", "b")]]


def test_unknown_rows_and_empty_table(spark):
    with pytest.raises(ValueError, match="no mapping"):
        cf.from_rows(spark.createDataFrame([(1, "a")], "conv_id long, words string"))
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cf.digests(cf.format_turns(cf.from_rows(empty))).count() == 0


def test_query_equals_sql_and_its_probe(spark):
    same_as_duckdb(cf.op2_chat_format, cf.ORACLE, spark, "/root/testdata/sf0.01")
    row = cf.op2_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, len(cf.PROBE), sha(cf.PROBE))
    assert row.turns_sha256 == sha(f"user\n{cf.PROBE}\nassistant\n{cf.PROBE}\n")
