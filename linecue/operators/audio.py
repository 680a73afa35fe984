"""Audio files of scripts: which file belongs to which paragraph, and where each goes in a joined narration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linecue.functions.text import natural_key, paragraph_id_in_name

# Extensions that folders and wildcards pick up.
AUDIO_EXTENSIONS = (".wav", ".mp3", ".m4a", ".flac", ".ogg", ".oga", ".opus", ".aac", ".wma", ".webm", ".mp4")
PARTS, PER_PARAGRAPH = "parts", "per-paragraph"
PARAGRAPH_GAP, CHAPTER_GAP, TRIM_PAD = 0.6, 1.2, 0.05


def audio_files(files: DataFrame) -> DataFrame:
    """files (script_id, name) that are audio by their extension, with file_ord in natural order."""
    found = files.where(F.regexp_extract(F.lower("name"), r"\.[^./]*$", 0).isin(*AUDIO_EXTENSIONS))
    return found.withColumn("file_ord", F.row_number().over(Window.partitionBy("script_id").orderBy(natural_key(F.col("name")), "name")) - 1)


def roles(files: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """files (script_id, file_ord, name) with para_id (null if the script has no such paragraph) and in_name."""
    known = paragraphs.select("script_id", F.col("id").alias("in_name"), F.col("id").alias("para_id"))
    return files.withColumn("in_name", paragraph_id_in_name(F.col("name"))).join(known, ["script_id", "in_name"], "left")


def modes(assigned: DataFrame) -> DataFrame:
    """(script_id, mode): one file a paragraph if most names, or all, hold an identifier and one at least is the script's."""
    n, matching, numbered = F.count("*"), F.count("para_id"), F.count("in_name")
    fits = (matching > 0) & ((matching * 2 > n) | (numbered == n))
    return assigned.groupBy("script_id").agg(F.when(fits, PER_PARAGRAPH).otherwise(PARTS).alias("mode"))


def ignored_warnings(assigned: DataFrame) -> DataFrame:
    """(script_id, file_ord, warning) of the files that no paragraph takes."""
    return assigned.where("para_id is null").select("script_id", "file_ord", F.concat("name", F.lit(": matches no paragraph of the script, ignored.")).alias("warning"))


def join_problems(assigned: DataFrame) -> DataFrame:
    """(script_id, line, message) of the scripts whose files can't be joined, as they aren't one a paragraph; lists the names that fit none."""
    names = F.transform(F.sort_array(F.collect_list(F.when(F.col("para_id").isNull(), F.struct("file_ord", "name")))), lambda x: x["name"])
    rows = modes(assigned).where(F.col("mode") != PER_PARAGRAPH).join(assigned.groupBy("script_id").agg(names.alias("names")), "script_id")
    said = F.when(F.size("names") == 0, "the files are parts of one recording, and only one file a paragraph can be joined").otherwise(F.concat(F.lit("only one file a paragraph can be joined, and no paragraph has "), F.array_join("names", ", ")))
    return rows.select("script_id", F.lit(None).cast("int").alias("line"), said.alias("message"))


def repeated_files(assigned: DataFrame) -> DataFrame:
    """(script_id, para_id, message) of paragraphs with more than one file; names the first two."""
    names = F.transform(F.sort_array(F.collect_list(F.struct("file_ord", "name"))), lambda x: x["name"])
    many = assigned.where("para_id is not null").groupBy("script_id", "para_id").agg(names.alias("names")).where(F.size("names") > 1)
    return many.select("script_id", "para_id", F.format_string("%s has two audio files: %s and %s", F.col("para_id"), F.get("names", F.lit(0)), F.get("names", F.lit(1))).alias("message"))


def file_spans(paragraphs: DataFrame, assigned: DataFrame, offset: float = 0.0) -> DataFrame:
    """Spans of files laid end to end in script order; a paragraph without file is missing. assigned has duration."""
    rows = paragraphs.join(assigned.where("para_id is not null").select("script_id", F.col("para_id").alias("id"), "duration"), ["script_id", "id"], "left")
    before = F.sum(F.coalesce("duration", F.lit(0.0))).over(Window.partitionBy("script_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    start = F.when(F.col("duration").isNotNull(), F.coalesce(before, F.lit(0.0)) + offset)
    found = F.col("duration").isNotNull()
    return rows.select("script_id", "ord", "id", "chapter_no", start.alias("start"), (start + F.col("duration")).alias("end"), F.when(found, 1.0).otherwise(0.0).alias("confidence"), F.when(found, "ok").otherwise("missing").alias("status"))


def trim_range(frames: Column, rate: Column, start: Column, end: Column, pad: float = TRIM_PAD) -> tuple[Column, Column]:
    """First and last frame to keep: `pad` seconds around the speech, rounded outwards, inside the file."""
    first = F.floor(F.bround((start - pad) * rate, 6)).cast("long")
    last = F.ceil(F.bround((end + pad) * rate, 6)).cast("long")
    return F.greatest(F.lit(0).cast("long"), first), F.least(frames, last)


def join_layout(entries: DataFrame, pauses: DataFrame, paragraph_gap: float = PARAGRAPH_GAP, chapter_gap: float = CHAPTER_GAP) -> DataFrame:
    """entries with offset_frames in the joined narration.

    entries: script_id, ord, id, chapter_no, rate, first_frame, last_frame, of
    the paragraphs with a file. pauses: script_id, id, pause. The gap before an
    entry is the previous one's pause, else the chapter's or the paragraph's.
    """
    order = Window.partitionBy("script_id").orderBy("ord")
    rows = entries.join(pauses.select("script_id", "id", "pause"), ["script_id", "id"], "left")
    changed = F.col("chapter_no") != F.lag("chapter_no").over(order)
    gap = F.coalesce(F.lag("pause").over(order), F.when(changed, chapter_gap).otherwise(paragraph_gap))
    rows = rows.withColumn("gap_frames", F.when(F.row_number().over(order) == 1, 0).otherwise(F.rint(gap * F.col("rate"))).cast("long"))
    before = F.sum(F.col("last_frame") - F.col("first_frame")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    gaps = F.sum("gap_frames").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("offset_frames", F.coalesce(before, F.lit(0)) + gaps).drop("gap_frames", "pause")


def unused_pauses(entries: DataFrame, pauses: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(script_id, id, warning) of pauses after a paragraph without file or after the last file."""
    last = entries.groupBy("script_id").agg(F.max_by("id", "ord").alias("last_id"))
    with_file = entries.select("script_id", "id", F.lit(True).alias("has_file"))
    rows = pauses.join(paragraphs.select("script_id", "id"), ["script_id", "id"], "left_semi").join(with_file, ["script_id", "id"], "left").join(last, "script_id", "left")
    is_last = F.coalesce(F.col("id") == F.col("last_id"), F.lit(False))
    reason = F.when(is_last, "no audio file follows it").otherwise("the paragraph has no audio file")
    return rows.where(F.col("has_file").isNull() | is_last).select("script_id", "id", F.concat("id", F.lit(": pause of "), F.col("pause").cast("string"), F.lit(" s ignored, "), reason, F.lit(".")).alias("warning"))


def format_problems(files: DataFrame) -> DataFrame:
    """(script_id, ord, name, message) of files whose format differs from the script's first; files: script_id, ord, name, channels, width, rate."""
    first = F.first(F.struct("name", "channels", "width", "rate")).over(Window.partitionBy("script_id").orderBy("ord"))
    rows = files.withColumn("first", first)
    says = lambda p: F.format_string("%d Hz, %d-bit, %d channel(s)", F.col(f"{p}rate"), F.col(f"{p}width") * 8, F.col(f"{p}channels"))
    odd = rows.where("channels <> first.channels OR width <> first.width OR rate <> first.rate")
    return odd.select("script_id", "ord", "name", F.format_string("%s is %s, but %s is %s; the files to join must all have one format", F.col("name"), says(""), F.col("first.name"), says("first.")).alias("message"))
