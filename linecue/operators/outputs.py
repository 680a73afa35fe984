"""Documents of each script as rows: chapter list and its warnings, markers, timing document and table.

Every function gives one row a script (or a line), so that a sink is one
`write`; `sources.files` turns rows into single files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linecue.functions.timefmt import Timebase, chapter_clock, frame_of, timecode, to_millis

LEAST_CHAPTERS, LEAST_SECONDS, FIRST_TOLERANCE = 3, 10, 1.0
HEADER = "id,chapter,start,end,duration,confidence,status"


def chapter_lines(chapters: DataFrame, ends: DataFrame) -> DataFrame:
    """(script_id, chapter_no, title, begin, length, line): found chapters; chapters: chapter_spans with title; ends: script_id, video_end."""
    order = Window.partitionBy("script_id").orderBy("chapter_no")
    rows = chapters.where("start is not null").join(ends, "script_id")
    rows = rows.withColumn("begin", F.when(F.row_number().over(order) == 1, F.lit(0).cast("long")).otherwise(F.floor("start").cast("long")))
    length = F.coalesce(F.lead("begin").over(order), F.floor("video_end").cast("long")) - F.col("begin")
    line = F.concat(chapter_clock(F.col("begin"), F.col("video_end") >= 3600), F.lit(" "), "title")
    return rows.select("script_id", "chapter_no", "title", "begin", length.alias("length"), line.alias("line"))


def chapter_warnings(chapters: DataFrame, ends: DataFrame) -> DataFrame:
    """(script_id, stage, chapter_no, warning), in order of stage and chapter_no."""
    found = chapters.where("start is not null")
    rows = chapters.groupBy("script_id").agg(F.count("*").alias("n"), F.count("start").alias("n_found"), F.min_by(F.struct("chapter_no", "title", "start"), F.when(F.col("start").isNotNull(), F.col("chapter_no"))).alias("first"))
    skipped = chapters.where("start is null").select("script_id", F.lit(0).alias("stage"), "chapter_no", F.format_string("chapters: '%s' skipped, none of its paragraphs was found.", "title").alias("warning"))
    none = rows.where("n_found = 0").select("script_id", F.lit(1).alias("stage"), F.lit(0).alias("chapter_no"), F.lit("chapters: no chapter was found, chapters.txt is not written.").alias("warning"))
    late = rows.where(F.col("first.start") > FIRST_TOLERANCE).select("script_id", F.lit(2).alias("stage"), F.lit(0).alias("chapter_no"), F.format_string("chapters: '%s' starts at %s but YouTube needs the first chapter at 00:00; it is written at 00:00.", F.col("first.title"), chapter_clock(F.col("first.start"), F.lit(False))).alias("warning"))
    short = chapter_lines(found, ends).where(F.col("length") < LEAST_SECONDS).select("script_id", F.lit(3).alias("stage"), "chapter_no", F.format_string(f"chapters: '%s' is only %d s long, YouTube needs at least {LEAST_SECONDS} s.", "title", "length").alias("warning"))
    few = rows.where((F.col("n_found") > 0) & (F.col("n_found") < LEAST_CHAPTERS) & (F.col("n") > 1))
    few = few.select("script_id", F.lit(4).alias("stage"), F.lit(0).alias("chapter_no"), F.format_string("chapters: only %d %s, YouTube needs at least 3.", F.col("n_found"), F.when(F.col("n_found") == 1, "chapter").otherwise("chapters")).alias("warning"))
    return skipped.union(none).union(late).union(short).union(few)


def markers(spans: DataFrame, base: Timebase) -> DataFrame:
    """(script_id, n, id, frame, begin, end): a numbered marker at the start of each found paragraph."""
    n = F.row_number().over(Window.partitionBy("script_id").orderBy("ord"))
    rows = spans.where("start is not null").select("script_id", n.alias("n"), "id", frame_of(F.col("start"), base).alias("frame"))
    return rows.withColumns({"begin": timecode(F.col("frame"), base), "end": timecode(F.col("frame") + 1, base)})


def edl_text(marked: DataFrame, titles: DataFrame) -> DataFrame:
    """(script_id, text): the marker file; titles: script_id, title of all scripts."""
    event = F.format_string("\n%03d  001      V     C        %s %s %s %s  \n |C:ResolveColorBlue |M:%s |D:1\n", "n", "begin", "end", "begin", "end", "id")
    events = marked.groupBy("script_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", event.alias("e")))), lambda x: x["e"]).alias("events"))
    head = F.format_string("TITLE: %s\nFCM: NON-DROP FRAME\n", F.regexp_replace("title", r"(?<=.)\.[^./]*$", ""))
    return titles.join(events, "script_id", "left").select("script_id", F.concat(head, F.coalesce(F.array_join("events", ""), F.lit(""))).alias("text"))


def timing_rows(spans: DataFrame) -> DataFrame:
    """spans (with chapter) at milliseconds: script_id, ord, id, chapter, start, end, duration, confidence, status."""
    return spans.select("script_id", "ord", "id", "chapter", to_millis(F.col("start")).alias("start"), to_millis(F.col("end")).alias("end"), to_millis(F.col("end") - F.col("start")).alias("duration"), to_millis(F.col("confidence")).alias("confidence"), "status")


def timing_csv(rows: DataFrame) -> DataFrame:
    """(script_id, ord, line): table lines, ord 0 the header; missing times are empty, cells with marks quoted."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    quoted = F.when(F.col("chapter").rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace("chapter", F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col("chapter"))
    line = F.concat_ws(",", "id", quoted, *(cell(c) for c in ("start", "end", "duration", "confidence")), "status")
    head = rows.select("script_id").distinct().select("script_id", F.lit(0).alias("ord"), F.lit(HEADER).alias("line"))
    return head.union(rows.select("script_id", (F.col("ord") + 1).alias("ord"), line.alias("line")))


def csv_text(lines: DataFrame) -> DataFrame:
    """(script_id, text): the table of each script as a file that spreadsheets open: a byte order mark, lines that end in CRLF."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ord", "line"))), lambda x: F.concat(x["line"], F.lit("\r\n")))
    return lines.groupBy("script_id").agg(F.concat(F.lit("\ufeff"), F.array_join(ordered, "")).alias("text"))


def timing_document(runs: DataFrame, audio: DataFrame, chapters: DataFrame, paragraphs: DataFrame, warnings: DataFrame) -> DataFrame:
    """(script_id, document): one JSON text a script, missing times as null.

    runs: script_id, tool, script, mode, offset, total_duration; audio:
    script_id, part_no, file, offset, duration; chapters: chapter_spans with
    title; paragraphs: timing_rows; warnings: script_id, seq, warning.
    """

    def listed(df: DataFrame, order: str, fields: list, name: str) -> DataFrame:
        rows = F.transform(F.sort_array(F.collect_list(F.struct(order, F.struct(*fields).alias("x")))), lambda r: r["x"])
        return df.groupBy("script_id").agg(rows.alias(name))

    ms = lambda c: to_millis(F.col(c)).alias(c)
    parts = [
        listed(audio, "part_no", ["file", ms("offset"), ms("duration")], "audio"),
        listed(chapters, "chapter_no", ["title", ms("start"), ms("end"), "first", "last"], "chapters"),
        listed(paragraphs, "ord", ["id", "chapter", "start", "end", "duration", "confidence", "status"], "paragraphs"),
    ]
    texts = warnings.groupBy("script_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "warning"))), lambda r: r["warning"]).alias("warnings"))
    rows = runs
    for part in (*parts, texts):
        rows = rows.join(part, "script_id", "left")
    empty = [F.coalesce(F.col(c), F.array()).alias(c) if c == "warnings" else F.col(c) for c in ("audio", "chapters", "paragraphs", "warnings")]
    body = F.struct(F.lit(1).alias("version"), "tool", "script", "mode", ms("offset"), ms("total_duration"), *empty)
    return rows.select("script_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))
