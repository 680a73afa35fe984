"""Words stay where their script is, charts go once to the spans, and figures in texts are rounded as SQL rounds them."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from linecue.functions.timefmt import fixed
from linecue.operators import charts
from linecue.operators.keyed import looked_up
from linecue.plans import registry

SF_DIR = os.environ.get("LINECUE_TEST_DIR", "/root/testdata/sf0.001")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["refine_boundaries", "align_words", "align_violations", "align_status"])
def test_words_are_not_dealt_by_their_place(spark, name):
    lines = [x for x in plan(registry.QUERIES[name](spark, SF_DIR)).splitlines() if "Exchange hashpartitioning" in x]
    assert lines and not [x for x in lines if any(c in x.partition("]")[0].partition("hashpartitioning")[2] for c in ("idx#", "gpos#", "at#", "word#", "free_from#", "free_to#"))]


@pytest.mark.parametrize("name", ["chart_problems", "chart_sequence", "chart_single", "chart_documents", "chart_warnings"])
def test_charts_go_once_to_the_spans(spark, name):
    text = plan(registry.QUERIES[name](spark, SF_DIR))
    assert text.count("median(") <= 2 and text.count("Scan parquet") <= 6


def test_a_row_is_looked_up_as_in_a_left_join(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, None, "c"), (2, 5, "d")], "s long, k int, x string")
    other = spark.createDataFrame([(1, 1, 0.5), (1, None, 9.0), (2, 4, 7.0)], "s long, k int, v double")
    assert sorted((r.x, r.v) for r in looked_up(rows, other, ["s", "k"], ["v"]).collect()) == [("a", 0.5), ("b", 0.5), ("c", None), ("d", None)]


def test_fixed_rounds_the_binary_value(spark):
    rand = random.Random(5)
    values = [32.65, 3.25, 0.125, 0.375, -3.25, 0.0, 0.045, *(k / 8 for k in range(200)), *(rand.randint(0, 200_000) / 1000 for _ in range(3000))]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", fixed(F.col("v"), 1).alias("a"), fixed(F.col("v"), 2).alias("b"))
    assert [(r.v, r.a, r.b) for r in df.collect() if (r.a, r.b) != (f"{r.v:.1f}", f"{r.v:.2f}")] == []


def test_a_script_without_any_known_paragraph_still_says_what_it_has(spark):
    made = spark.createDataFrame([(1, 0, "c", ["P1", "P2"], False), (2, 0, "d", ["P1"], False)], "script_id long, chart_ord int, id string, paragraphs array<string>, sequence boolean")
    spans = spark.createDataFrame([(1, 0, "P7", 1.0, 2.0, 1.0, "ok"), (1, 1, "P9", 2.0, 3.0, 1.0, "ok")], "script_id long, ord int, id string, start double, end double, confidence double, status string")
    got = sorted((r.script_id, r.k, r.message) for r in charts.chart_problems(made, spans).collect())
    says = "charts.{}: {} is not in the timing file (it has {})"
    assert got == [(1, 0, says.format("c", "P1", "P7 to P9")), (1, 1, says.format("c", "P2", "P7 to P9")), (2, 0, says.format("d", "P1", "no paragraphs"))]
