"""How much goes through the costly steps, and that the results stay the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from linecue.functions import unicode
from linecue.operators import script
from linecue.operators.timeline import join_decimals
from linecue.plans import bridge, registry


def test_only_joined_words_meet_in_groups(spark):
    texts = ["costs", "$49", ".99", ".5", "and", "7", ".25", "."]
    rows = spark.createDataFrame([(1, 0, i, f" {t} ", i * 1.0, i + 0.5) for i, t in enumerate(texts)], "script_id long, part_no int, idx int, text string, start double, end double")
    found = join_decimals(rows)
    assert [(r.idx, r.text, r.start, r.end) for r in found.orderBy("idx").collect()] == [(0, "costs", 0.0, 0.5), (1, "$49.99.5", 1.0, 3.5), (4, "and", 4.0, 4.5), (5, "7.25", 5.0, 6.5), (7, ".", 7.0, 7.5)]
    # Words that stand alone go beside the grouping, not through it.
    assert "Union" in found._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_grow_with_the_texts(spark, monkeypatch):
    """Twice the texts are twice the tasks, not tasks of twice the words."""
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(bridge, "TASK_BYTES", 1000)
    dealt = bridge.paragraphs(spark, "/root/testdata/sf0.001")
    assert dealt.rdd.getNumPartitions() == bridge.tasks(spark, "/root/testdata/sf0.001") > few


def test_documents_of_one_row_group_are_many_tasks(spark):
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    documents = registry.normalize_numbers(spark, "/root/testdata/sf0.001").where("ord = -1")
    assert documents.select(F.spark_partition_id()).distinct().count() == few


def test_plain_letters_are_passed_before_the_long_classes():
    """Classes of many ranges come after short ones of what stands between their ranges."""
    special, joining, _ = unicode._classes()
    for pattern in (special, joining):
        first = pattern.partition("]")[0]
        assert first.startswith("(?![\\x{0}-") and len(first) < 60 < len(pattern)


def test_tokens_stay_with_their_script(spark):
    """Spans are dealt once before they are cut into tokens; no token is dealt by its place."""
    plan = registry.caption_cues(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") + plan.count("FlatMapGroupsInPandas") == 1 and "tok#" not in "".join(line for line in plan.split("\n") if "Exchange" in line)
    assert plan.count("Exchange hashpartitioning") <= 6


def test_problems_read_and_deal_the_lines_once(spark):
    lines = script.script_lines(spark.createDataFrame([(1, "P1 - a\n> b")], "script_id long, text string"))
    plan = script.problems(lines)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate posexplode") == 1 and plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
