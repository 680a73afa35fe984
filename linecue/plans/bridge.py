"""Script relations derived from the general tables, the same in Spark and in SQL.

A conversation is a script, a turn a paragraph, two turns a chapter. What was
heard is the script's words without some, with others reversed and with some
paragraphs left out, by whole-number rules. Times are milliseconds as doubles.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linecue.functions.text import plain_words
from linecue.operators import script
from linecue.operators.keyed import dealt
from linecue.sources.tables import table


#: Bytes of text that one task's words come from; in a task they take about a hundred times that, and more would be spilled by every sort.
TASK_BYTES = 2 << 20


@functools.lru_cache(maxsize=64)
def _tasks(spark: SparkSession, sf_dir: str, task_bytes: int) -> int:
    return (table(spark, sf_dir, "conversations").agg(F.sum(F.octet_length("text"))).first()[0] or 0) // task_bytes + 1


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks that the scripts are dealt to at least; they grow with the texts, so a task's words don't."""
    return _tasks(spark, sf_dir, TASK_BYTES)


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt by script as whole texts: all that follows, words included, stays where it is."""
    turns = dealt(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("script_id"), "turn", "text"), "script_id", tasks=tasks(spark, sf_dir))
    return turns.select("script_id", F.col("turn").cast("int").alias("ord"), F.concat(F.lit("P"), F.col("turn") + 1).alias("id"), F.floor(F.col("turn") / 2).cast("int").alias("chapter_no"), "text")


def script_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return script.script_words(paragraphs(spark, sf_dir), plain_words(F.col("text")))


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script words, whether they were heard (kept) and changed, and idx, the number of heard words before them."""
    h = F.pmod(F.col("gpos") * F.lit(7919).cast("long") + F.col("script_id") * 104729, F.lit(100))
    rows = script_words(spark, sf_dir).withColumn("h", h)
    rows = rows.withColumns({"kept": ((F.col("script_id") * 31 + F.col("ord")) % 11 != 0) & (F.col("h") >= 3), "changed": F.col("h") <= 5})
    before = Window.partitionBy("script_id").orderBy("gpos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("idx", F.coalesce(F.sum(F.col("kept").cast("int")).over(before), F.lit(0)).cast("int"))


def heard_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _told(spark, sf_dir).where("kept").select("script_id", "ord", "gpos", "idx", F.when(F.col("changed"), F.reverse("word")).otherwise(F.col("word")).alias("word"), "changed")
    start = (F.col("idx") * 500 + F.col("ord") * 1000).cast("double")
    return rows.withColumns({"part_no": F.floor(F.col("ord") / 2).cast("int"), "start": start, "end": start + 400 - (F.col("idx") % 5) * 20})


def true_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which word was heard for which, as the rules made it."""
    found = F.col("kept") & ~F.col("changed")
    return _told(spark, sf_dir).select("script_id", "ord", "pos", "gpos", F.when(found, F.col("idx")).alias("heard_idx"), F.when(found, 1.0).alias("similarity"))


def known_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script words with true_idx, the heard word of true_matches."""
    return _told(spark, sf_dir).select("script_id", "gpos", "word", F.when(F.col("kept") & ~F.col("changed"), F.col("idx")).alias("true_idx"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech of each heard paragraph; it begins early in every second one."""
    rows = heard_words(spark, sf_dir).groupBy("script_id", "part_no", "ord").agg(F.min("start").alias("s"), F.max("end").alias("e"))
    return rows.select("script_id", "part_no", F.when(F.col("ord") % 2 == 1, F.col("s") - 450).otherwise(F.col("s") + 120).alias("start"), (F.col("e") - 70).alias("end"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(spark, sf_dir).select("script_id", F.col("ord").alias("part_no"), F.length("text").cast("double").alias("duration"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of as many frames as the paragraph has characters; every seventh paragraph has none."""
    rows = paragraphs(spark, sf_dir).where((F.col("script_id") + F.col("ord")) % 7 != 3)
    return rows.select("script_id", "ord", "id", "chapter_no", F.lit(1000.0).alias("rate"), F.lit(0).cast("long").alias("first_frame"), F.length("text").cast("long").alias("last_frame"))


def pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(spark, sf_dir).where((F.col("script_id") + F.col("ord")) % 5 == 0).select("script_id", "id", (F.col("ord") + 1.5).alias("pause"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file name a paragraph; some name no paragraph of the script, or none at all."""
    k = F.col("script_id") + F.col("ord")
    name = F.when(k % 6 == 1, F.concat(F.lit("intro_"), "ord", F.lit(".wav"))).when(k % 6 == 2, F.concat(F.lit("p"), F.col("ord") + 100, F.lit("_x.mp3"))).otherwise(F.concat(F.lit("take-p0"), F.col("ord") + 1, F.lit(".wav")))
    return paragraphs(spark, sf_dir).select("script_id", F.col("ord").alias("file_ord"), name.alias("name"))


def script_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents dressed as scripts, with headings, quotes, tags and some wrong numbers."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("script_id"), F.posexplode(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r", " "), "\n")).alias("k", "t"))
    k = F.col("k") + 1
    n = F.floor(k / 3) + 1 - F.when(k % 15 == 5, 1).otherwise(0)
    chart = F.concat(F.lit(" <!-- chart: c"), k % 4, F.when(k % 12 == 0, ", sequence").otherwise(""), F.lit(" -->"))
    pause = F.concat(F.lit(" <!-- pause: "), k % 2, F.lit(".5 -->"))
    text = (
        F.when(k % 12 == 1, F.concat(F.lit("## "), k, F.lit(". Part / "), k, F.lit(". Title "), k))
        .when(k % 3 == 2, F.concat(F.lit("P"), n, F.lit(" — "), "t"))
        .when(k % 6 == 0, F.concat(F.lit("> "), "t", chart))
        .when(k % 9 == 0, F.concat(F.lit("> "), "t", pause))
        .when(k % 21 == 0, F.concat(F.lit("P"), k, F.lit(" ")))
        .otherwise(F.col("t"))
    )
    return rows.select("script_id", k.alias("line"), text.alias("text"))


def charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three charts a script: of two paragraphs, of a sequence of three, and of two that don't follow one another."""
    scripts = paragraphs(spark, sf_dir).select("script_id").distinct()
    named = lambda *p: F.array(*map(F.lit, p))
    kinds = F.array(
        F.struct(F.lit(0).alias("chart_ord"), F.lit("pair").alias("id"), named("P1", "P2").alias("paragraphs"), F.lit(False).alias("sequence")),
        F.struct(F.lit(1).alias("chart_ord"), F.lit("steps").alias("id"), named("P2", "P3", "P4").alias("paragraphs"), F.lit(True).alias("sequence")),
        F.struct(F.lit(2).alias("chart_ord"), F.lit("apart").alias("id"), named("P1", "P4").alias("paragraphs"), F.lit(False).alias("sequence")),
    )
    return scripts.select("script_id", F.explode(kinds).alias("c")).select("script_id", "c.*")


SQL = r"""
WITH paragraphs AS (SELECT conv_id AS script_id, CAST(turn AS INTEGER) AS ord, 'P' || (turn + 1) AS id, CAST(turn // 2 AS INTEGER) AS chapter_no, text FROM conversations),
texts AS (SELECT script_id, ord, list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[\p{P}\p{S}]', '', 'g'), '\s+'), lambda w: w <> '') AS ws FROM paragraphs),
words_at AS (SELECT script_id, ord, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM texts),
script_words AS (SELECT script_id, ord, CAST(pos AS INTEGER) AS pos, CAST(row_number() OVER (PARTITION BY script_id ORDER BY ord, pos) - 1 AS INTEGER) AS gpos, word FROM words_at),
planned AS (SELECT *, (gpos * 7919 + script_id * 104729) % 100 AS h FROM script_words WHERE (script_id * 31 + ord) % 11 <> 0),
heard_at AS (SELECT script_id, ord, gpos, CAST(row_number() OVER (PARTITION BY script_id ORDER BY gpos) - 1 AS INTEGER) AS idx, CASE WHEN h <= 5 THEN reverse(word) ELSE word END AS word, h <= 5 AS changed FROM planned WHERE h >= 3),
heard_words AS (SELECT *, CAST(ord // 2 AS INTEGER) AS part_no, CAST(idx * 500 + ord * 1000 AS DOUBLE) AS s, CAST(idx * 500 + ord * 1000 + 400 - (idx % 5) * 20 AS DOUBLE) AS e FROM heard_at),
matches AS (
  SELECT w.script_id, w.ord, w.pos, w.gpos, h.idx AS heard_idx, CASE WHEN h.idx IS NOT NULL THEN 1.0::DOUBLE END AS similarity, h.s, h.e
  FROM script_words w LEFT JOIN (SELECT * FROM heard_words WHERE NOT changed) h ON w.script_id = h.script_id AND w.gpos = h.gpos),
segments AS (SELECT script_id, part_no, ord, CASE WHEN ord % 2 = 1 THEN min(s) - 450 ELSE min(s) + 120 END AS seg_s, max(e) - 70 AS seg_e FROM heard_words GROUP BY script_id, part_no, ord),
parts AS (SELECT script_id, ord AS part_no, CAST(length(text) AS DOUBLE) AS duration FROM paragraphs),
entries AS (SELECT script_id, ord, id, chapter_no, length(text)::BIGINT AS frames FROM paragraphs WHERE (script_id + ord) % 7 <> 3),
pauses AS (SELECT script_id, ord, id, (ord + 1.5)::DOUBLE AS pause FROM paragraphs WHERE (script_id + ord) % 5 = 0),
files AS (
  SELECT script_id, ord AS file_ord, CASE (script_id + ord) % 6 WHEN 1 THEN 'intro_' || ord || '.wav' WHEN 2 THEN 'p' || (ord + 100) || '_x.mp3' ELSE 'take-p0' || (ord + 1) || '.wav' END AS name FROM paragraphs),
assigned AS (
  SELECT f.*, n.in_name, p.id AS para_id
  FROM files f JOIN (SELECT script_id, file_ord, CASE WHEN regexp_matches(name, '(^|[^A-Za-z0-9])[Pp][0-9]') THEN 'P' || CAST(regexp_extract(name, '(?:^|[^A-Za-z0-9])[Pp]([0-9]+)', 1) AS INTEGER) END AS in_name FROM files) n USING (script_id, file_ord)
  LEFT JOIN paragraphs p ON p.script_id = f.script_id AND p.id = n.in_name),
charts AS (
  SELECT script_id, unnest([0, 1, 2]) AS chart_ord, unnest(['pair', 'steps', 'apart']) AS chart, unnest([['P1', 'P2'], ['P2', 'P3', 'P4'], ['P1', 'P4']]) AS names, unnest([false, true, false]) AS sequence
  FROM (SELECT DISTINCT script_id FROM paragraphs)),
raw AS (
  SELECT script_id, ord, count(*) AS n, count(heard_idx) AS matched, coalesce(sum(similarity), 0) / count(*) AS confidence, min(heard_idx) AS first_idx, max(heard_idx) AS last_idx,
    min(CASE WHEN heard_idx IS NOT NULL THEN pos END) AS lead_in, count(*) - 1 - max(CASE WHEN heard_idx IS NOT NULL THEN pos END) AS lead_out, min(s) AS s, max(e) AS e, median(e - s) AS word_length
  FROM matches GROUP BY script_id, ord),
judged AS (
  SELECT p.script_id, p.ord, p.id, p.chapter_no, coalesce(n, 0) AS n, coalesce(matched, 0) AS matched, coalesce(confidence, 0) AS confidence, first_idx, last_idx, lead_in, lead_out, s, e, word_length,
    CASE WHEN coalesce(matched, 0) = 0 OR matched / greatest(n, 1) < 0.3 THEN 'missing' WHEN confidence < 0.8 THEN 'low_confidence' ELSE 'ok' END AS status
  FROM paragraphs p LEFT JOIN raw USING (script_id, ord)),
found AS (
  SELECT j.*, coalesce(lag(last_idx) OVER w + 1, 0) AS free_from, coalesce(lead(first_idx) OVER w - 1, last_word) AS free_to
  FROM judged j JOIN (SELECT script_id, max(idx) AS last_word FROM heard_words GROUP BY ALL) USING (script_id) WHERE status <> 'missing' WINDOW w AS (PARTITION BY script_id ORDER BY ord)),
wishes AS (
  SELECT f.*, CASE WHEN free_from < first_idx THEN greatest(0.0, least(lead_in * word_length, f.s - a.s)) ELSE 0.0 END AS move_s,
    CASE WHEN last_idx < free_to THEN greatest(0.0, least(lead_out * word_length, b.e - f.e)) ELSE 0.0 END AS move_e
  FROM found f LEFT JOIN heard_words a ON a.script_id = f.script_id AND a.idx = f.free_from LEFT JOIN heard_words b ON b.script_id = f.script_id AND b.idx = f.free_to),
rooms AS (SELECT *, greatest(0.0, lead(s) OVER w - e) AS room_e, greatest(0.0, s - lag(e) OVER w) AS room_s, lead(move_s) OVER w AS next_move, lag(move_e) OVER w AS last_move FROM wishes WINDOW w AS (PARTITION BY script_id ORDER BY ord)),
moved AS (
  SELECT script_id, ord, s - CASE WHEN last_move IS NULL OR move_s + last_move <= room_s THEN move_s ELSE move_s * (room_s / (move_s + last_move)) END AS t0,
    e + CASE WHEN next_move IS NULL OR move_e + next_move <= room_e THEN move_e ELSE move_e * (room_e / (move_e + next_move)) END AS t1 FROM rooms),
spans AS (SELECT j.* EXCLUDE (s, e), t0 / 1000 AS s, t1 / 1000 AS e FROM judged j LEFT JOIN moved USING (script_id, ord))"""

LINES_SQL = r"""
WITH cut AS (SELECT doc_id AS script_id, string_split(replace(coalesce(text, ''), chr(13), ' '), chr(10)) AS ts FROM documents),
numbered AS (SELECT script_id, unnest(ts) AS t, unnest(range(1, len(ts) + 1)) AS k FROM cut),
lines AS (
  SELECT script_id, CAST(k AS INTEGER) AS line, CASE
    WHEN k % 12 = 1 THEN '## ' || k || '. Part / ' || k || '. Title ' || k
    WHEN k % 3 = 2 THEN 'P' || (k // 3 + 1 - CASE WHEN k % 15 = 5 THEN 1 ELSE 0 END) || ' — ' || t
    WHEN k % 6 = 0 THEN '> ' || t || ' <!-- chart: c' || (k % 4) || CASE WHEN k % 12 = 0 THEN ', sequence' ELSE '' END || ' -->'
    WHEN k % 9 = 0 THEN '> ' || t || ' <!-- pause: ' || (k % 2) || '.5 -->'
    WHEN k % 21 = 0 THEN 'P' || k || ' ' ELSE t END AS text FROM numbered),
kinds AS (
  SELECT *, CASE WHEN regexp_matches(text, '^(?:\*\*[Pp]\d+\*\*|__[Pp]\d+__|\*[Pp]\d+\*|[Pp]\d+)[ \t]*[—–\-:.]') THEN 'paragraph'
    WHEN regexp_matches(text, '^(?:\*\*[Pp]\d+\*\*|__[Pp]\d+__|\*[Pp]\d+\*|[Pp]\d+)(?:\s|$)') THEN 'unseparated'
    WHEN regexp_matches(text, '^#{1,6}(?:[ \t].*)?$') THEN 'heading' WHEN starts_with(text, '>') THEN 'quote' WHEN regexp_matches(text, '^\s*$') THEN 'blank' ELSE 'text' END AS kind FROM lines),
numbers AS (SELECT *, CASE WHEN kind IN ('paragraph', 'unseparated') THEN CAST(regexp_extract(text, '\d+') AS INTEGER) END AS number, CASE WHEN kind = 'heading' THEN length(regexp_extract(text, '^#+')) END AS level FROM kinds),
bounds AS (
  SELECT *, CAST(sum(CASE WHEN kind = 'heading' AND level IN (2, 3) THEN 1 ELSE 0 END) OVER w AS BIGINT) AS chapter_key,
    last_value(CASE WHEN kind IN ('paragraph', 'unseparated', 'heading') THEN {'line': line, 'kind': kind} END IGNORE NULLS) OVER w AS bound
  FROM numbers WINDOW w AS (PARTITION BY script_id ORDER BY line ROWS UNBOUNDED PRECEDING)),
outline AS (SELECT * EXCLUDE bound, CASE WHEN bound.kind = 'paragraph' THEN bound.line END AS owner FROM bounds)"""
