"""Heard words on a common timeline: parts laid end to end, words shifted, held to speech, cut and joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linecue.functions.text import NUMBER_WORDS, fold_text, merge_numbers

TOLERANCE, LEAST_LENGTH, MIN_PULL, MAX_PULL = 0.05, 0.02, 0.3, 2.0


def build_timeline(parts: DataFrame, gap: float = 0.0, offset: float = 0.0) -> DataFrame:
    """parts (script_id, part_no, duration) with the offset of each: all durations and gaps before it."""
    before = Window.partitionBy("script_id").orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("offset", F.coalesce(F.sum(F.col("duration") + gap).over(before), F.lit(0.0)) + offset)


def total_duration(parts: DataFrame, gap: float = 0.0) -> DataFrame:
    """(script_id, total_duration): durations with a gap between each two."""
    return parts.groupBy("script_id").agg((F.sum("duration") + gap * (F.count("*") - 1)).alias("total_duration"))


def shift_words(words: DataFrame, timeline: DataFrame) -> DataFrame:
    """Words of all parts at the times of the whole, with idx over the whole script."""
    moved = words.join(timeline.select("script_id", "part_no", "offset"), ["script_id", "part_no"])
    order = Window.partitionBy("script_id").orderBy("part_no", "idx")
    return moved.withColumns({"start": F.col("start") + F.col("offset"), "end": F.col("end") + F.col("offset"), "idx": F.row_number().over(order) - 1}).drop("offset")


def snap_to_speech(words: DataFrame, segments: DataFrame, tolerance: float = TOLERANCE, least: float = LEAST_LENGTH, min_pull: float = MIN_PULL, max_pull: float = MAX_PULL) -> DataFrame:
    """Words held inside the speech they were heard in; the first word of a segment is pulled back to its start.

    words: script_id, part_no, idx, start, end. segments: script_id, part_no,
    start, end, sorted and apart. A word belongs to the first segment that ends
    after the word begins: an as-of join, made of one union and one window, so
    no word is compared with more than one segment. Words without a segment
    stay as they are.
    """
    keys = ["script_id", "part_no"]
    ends = segments.select(*keys, F.col("end").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(words.schema["idx"].dataType).alias("idx"), F.struct("start", "end").alias("segment"))
    begins = words.select(*keys, F.col("start").alias("at"), F.lit(1).alias("kind"), "idx", F.lit(None).cast(ends.schema["segment"].dataType).alias("segment"))
    # Segments that end where a word begins come before it and are passed over.
    ahead = Window.partitionBy(*keys).orderBy("at", "kind", "idx").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    near = ends.union(begins).withColumn("segment", F.first("segment", ignorenulls=True).over(ahead)).where("kind = 1").select(*keys, "idx", "segment")
    held = words.join(near, [*keys, "idx"])
    over = F.coalesce(F.col("segment.start") < F.col("end"), F.lit(False))
    start = F.when(over & (F.col("segment.start") - F.col("start") >= tolerance), F.col("segment.start")).otherwise(F.col("start"))
    end = F.when(over & (F.col("end") - F.col("segment.end") >= tolerance), F.col("segment.end")).otherwise(F.col("end"))
    held = held.withColumns({"over": over, "s": start, "e": end})
    thin = F.col("e") - F.col("s") < least
    held = held.withColumns({"s": F.when(thin, F.col("start")).otherwise(F.col("s")), "e": F.when(thin, F.col("end")).otherwise(F.col("e"))})
    first = F.row_number().over(Window.partitionBy(*keys, "over", "segment").orderBy("idx")) == 1
    held = held.withColumns({"first": F.col("over") & first, "previous": F.lag("e").over(Window.partitionBy(*keys).orderBy("idx"))})
    late = F.col("s") - F.col("segment.start")
    target = F.greatest(F.col("segment.start"), F.coalesce("previous", F.col("segment.start")))
    pulled = F.when(F.col("first") & (late >= min_pull) & (late <= max_pull) & (target < F.col("s")), target).otherwise(F.col("s"))
    return held.withColumns({"start": pulled, "end": F.col("e")}).drop("segment", "over", "s", "e", "first", "previous")


def join_decimals(words: DataFrame) -> DataFrame:
    """Words such as `$49` and `.99` as one, from the first one's start to the last one's end; chains too."""
    keys = ["script_id", "part_no"]
    order = Window.partitionBy(*keys).orderBy("idx")
    text = F.trim(F.col("text"))
    goes_on = F.coalesce(F.trim(F.lag("text").over(order)).rlike(r"\p{Nd}$") & text.rlike(r"^\.\p{Nd}"), F.lit(False))
    flagged = words.withColumn("goes_on", goes_on).withColumn("goes_on_after", F.coalesce(F.lead("goes_on").over(order), F.lit(False)))
    columns = [*keys, "idx", "text", "start", "end"]
    alone = flagged.where("NOT goes_on AND NOT goes_on_after").select(*keys, "idx", text.alias("text"), "start", "end")
    # Only words that are joined meet in groups; most words stand alone and go through as they are.
    runs = flagged.where("goes_on OR goes_on_after").withColumn("run", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = runs.groupBy(*keys, "run").agg(
        F.min("idx").alias("idx"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", F.trim("text").alias("t")))), lambda x: x["t"]), "").alias("text"),
        F.min_by("start", "idx").alias("start"),
        F.max_by("end", "idx").alias("end"),
    )
    return joined.select(columns).union(alone)


def split_words(words: DataFrame, tokens: Column) -> DataFrame:
    """A row for each token of a word, its time shared evenly; words without tokens go."""
    rows = words.withColumn("tokens", tokens).withColumn("k", F.size("tokens"))
    rows = rows.select(*[c for c in rows.columns if c != "tokens"], F.posexplode("tokens").alias("sub", "word"))
    step = (F.col("end") - F.col("start")) / F.col("k")
    end = F.when(F.col("sub") == F.col("k") - 1, F.col("end")).otherwise(F.col("start") + (F.col("sub") + 1) * step)
    return rows.withColumns({"new_start": F.col("start") + F.col("sub") * step, "new_end": end}).drop("start", "end", "text", "k").withColumnsRenamed({"new_start": "start", "new_end": "end"})


def normalize_words(words: DataFrame) -> DataFrame:
    """(script_id, part_no, idx, word, start, end): timed comparable words; decimals joined, hyphenated words split, numbers in digits.

    Only words that can be part of a number meet, those that follow one another:
    a run of them is one group, however long the part is.
    """
    keys = ["script_id", "part_no"]
    tokens = split_words(join_decimals(words), fold_text(F.col("text"))).select(*keys, "idx", "sub", "word", "start", "end")
    order = Window.partitionBy(*keys).orderBy("idx", "sub")
    # What can't be part of a number is a run of its own.
    tokens = tokens.withColumn("spelled", F.col("word").isin(*NUMBER_WORDS))
    fresh = ~(F.col("spelled") & F.coalesce(F.lag("spelled").over(order), F.lit(False)))
    runs = tokens.withColumn("run", F.sum(fresh.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    gathered = runs.where("spelled").groupBy(*keys, "run").agg(F.sort_array(F.collect_list(F.struct("idx", "sub", "word", "start", "end"))).alias("ws"))
    merged = gathered.select(*keys, "run", "ws", merge_numbers(F.transform("ws", lambda w: w["word"])).alias("m"))
    merged = merged.select(*keys, "run", "ws", F.posexplode("m").alias("k", "x"), F.transform("m", lambda x: x["n"]).alias("n"))
    before = F.aggregate(F.slice("n", F.lit(1), F.col("k")), F.lit(0), lambda acc, n: acc + n)
    merged = merged.select(*keys, "run", "k", F.col("x.word").alias("word"), F.get("ws", before)["start"].alias("start"), F.get("ws", before + F.col("x.n") - 1)["end"].alias("end"))
    rows = merged.union(runs.where("NOT spelled").select(*keys, "run", F.lit(0).alias("k"), "word", "start", "end"))
    return rows.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("run", "k")) - 1).alias("idx"), "word", "start", "end")


def speech_segments(levels: DataFrame, frame: float, pause: float, share: float = 0.05, quantile: float = 0.98, least: float = 0.2) -> DataFrame:
    """(script_id, part_no, k, start, end): stretches of frames louder than a share of the loud level, apart by `pause` or more.

    levels: script_id, part_no, i, level; frames of `frame` seconds.
    """
    keys = ["script_id", "part_no"]
    # The level at that place in order, from counts of equal levels: a part of any length is never one value.
    counts = levels.groupBy(*keys, "level").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = counts.select(*keys, "level", upto.alias("upto"), F.sum("n").over(Window.partitionBy(*keys)).alias("all"))
    loud = counts.where(F.col("upto") > F.floor(F.col("all") * quantile)).groupBy(*keys).agg(F.min("level").alias("loud"))
    heard = levels.join(loud, keys).where(F.col("level") > F.greatest(F.lit(1.0), F.col("loud") * share))
    order = Window.partitionBy(*keys).orderBy("i")
    fresh = F.coalesce((F.col("i") - F.lag("i").over(order) - 1) * frame >= pause, F.lit(True))
    runs = heard.withColumn("run", F.sum(fresh.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = runs.groupBy(*keys, "run").agg((F.min("i") * frame).alias("start"), ((F.max("i") + 1) * frame).alias("end")).where(F.col("end") - F.col("start") >= least)
    return out.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("start")) - 1).select(*keys, "k", "start", "end")
