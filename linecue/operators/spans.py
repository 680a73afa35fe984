"""Matched words to paragraph spans: confidence, status, refined bounds, pace, chapters and warnings.

All of it is aggregation and windows over script_id, so words that are dealt
by script_id stay where they are. Times may be in any unit, as long as all are
in the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linecue.functions.timefmt import fixed
from linecue.operators.keyed import looked_up

OK, LOW, MISSING = "ok", "low_confidence", "missing"
LEAST_MATCHED, MIN_CONFIDENCE = 0.3, 0.8
SLOW_FACTOR, SLOW_SECONDS, SLOW_PARAGRAPHS = 3.0, 5.0, 3


def status_of(n: Column, matched: Column, confidence: Column, min_confidence: float = MIN_CONFIDENCE) -> Column:
    """missing if nothing or less than LEAST_MATCHED of the words was matched, low_confidence below min_confidence, else ok."""
    return F.when((matched == 0) | (matched / F.greatest(n, F.lit(1)) < LEAST_MATCHED), MISSING).when(confidence < min_confidence, LOW).otherwise(OK)


#: Of the heard words around a matched one: the end of the one before, the start of the one after, where the script's first and last begin and end, and the last one's number.
AROUND = ["end_before", "start_after", "script_start", "script_end", "last_word"]


def _neighbours(heard: DataFrame) -> DataFrame:
    """heard with heard_idx for idx and AROUND."""
    order, script = Window.partitionBy("script_id").orderBy("idx"), Window.partitionBy("script_id")
    beside = lambda f, value, by: F.when(f("idx").over(order) == F.col("idx") + by, f(value).over(order))
    return heard.select(
        "script_id",
        F.col("idx").alias("heard_idx"),
        "start",
        "end",
        beside(F.lag, "end", -1).alias("end_before"),
        beside(F.lead, "start", 1).alias("start_after"),
        F.max(F.when(F.col("idx") == 0, F.col("start"))).over(script).alias("script_start"),
        F.max_by("end", "idx").over(script).alias("script_end"),
        F.max("idx").over(script).alias("last_word"),
    )


def paragraph_matches(matches: DataFrame, heard: DataFrame) -> DataFrame:
    """Per paragraph: words, matches, confidence, first and last heard word, unmatched words at either edge, median word length.

    matches: script_id, ord, pos, heard_idx, similarity. heard: script_id, idx, start, end.
    """
    hit = F.col("heard_idx").isNotNull()
    return (
        looked_up(matches, _neighbours(heard), ["script_id", "heard_idx"], ["start", "end", *AROUND])
        .groupBy("script_id", "ord")
        .agg(
            F.count("*").alias("n"),
            F.count("heard_idx").alias("matched"),
            (F.coalesce(F.sum("similarity"), F.lit(0.0)) / F.count("*")).alias("confidence"),
            F.min("heard_idx").alias("first_idx"),
            F.max("heard_idx").alias("last_idx"),
            F.min(F.when(hit, F.col("pos"))).alias("before"),
            (F.count("*") - 1 - F.max(F.when(hit, F.col("pos")))).alias("after"),
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.median(F.col("end") - F.col("start")).alias("word_length"),
            F.transform(F.sort_array(F.collect_list(F.struct("pos", F.when(hit, F.struct("start", "end")).alias("time")))), lambda x: x["time"]).alias("word_times"),
            F.min_by("end_before", "heard_idx").alias("end_before"),
            F.max_by("start_after", "heard_idx").alias("start_after"),
            *(F.max(c).alias(c) for c in ("script_start", "script_end", "last_word")),
        )
    )


def raw_spans(paragraphs: DataFrame, matches: DataFrame, heard: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Every paragraph with its matches and its status; one without words is missing with confidence 0."""
    found = paragraphs.join(paragraph_matches(matches, heard), ["script_id", "ord"], "left")
    found = found.fillna({"n": 0, "matched": 0, "confidence": 0.0})
    return found.withColumn("status", status_of(F.col("n"), F.col("matched"), F.col("confidence"), min_confidence))


def refine(spans: DataFrame) -> DataFrame:
    """raw_spans whose bounds grow over free heard words where words at the edge of a paragraph went unmatched.

    Each edge moves by as many median word lengths as words are unmatched
    there, but not past the free words; neighbours that want the same room
    share it in proportion. Only found paragraphs are neighbours. Missing
    paragraphs get null times.
    """
    # Found paragraphs are each other's neighbours in a partition of their own, so the rows of the others stay in the frame.
    order = Window.partitionBy("script_id", "found").orderBy("ord")
    rows = spans.withColumn("found", F.col("status") != MISSING)
    # The free words reach from the neighbours' matches, or from the ends of the script.
    behind, ahead = F.lag("last_idx").over(order), F.lead("first_idx").over(order)
    rows = rows.withColumns({"free_from": F.coalesce(behind + 1, F.lit(0)), "free_to": F.coalesce(ahead - 1, F.col("last_word"))})
    rows = rows.withColumns({"free_start": F.when(behind.isNull(), F.col("script_start")).otherwise(F.lag("start_after").over(order)), "free_end": F.when(ahead.isNull(), F.col("script_end")).otherwise(F.lead("end_before").over(order))})
    zero = F.lit(0.0)
    wish_start = F.when(F.col("free_from") < F.col("first_idx"), F.greatest(zero, F.least(F.col("before") * F.col("word_length"), F.col("start") - F.col("free_start")))).otherwise(zero)
    wish_end = F.when(F.col("last_idx") < F.col("free_to"), F.greatest(zero, F.least(F.col("after") * F.col("word_length"), F.col("free_end") - F.col("end")))).otherwise(zero)
    rows = rows.withColumns({"move_start": wish_start, "move_end": wish_end})

    def share(room: Column, mine: Column, other: Column) -> Column:
        room = F.greatest(zero, room)
        return F.when(mine + other > room, mine * (room / (mine + other))).otherwise(mine)

    rows = rows.withColumns({"room_after": F.lead("start").over(order) - F.col("end"), "room_before": F.col("start") - F.lag("end").over(order), "next_move": F.lead("move_start").over(order), "last_move": F.lag("move_end").over(order)})
    end = F.col("end") + F.when(F.col("room_after").isNull(), F.col("move_end")).otherwise(share(F.col("room_after"), F.col("move_end"), F.col("next_move")))
    start = F.col("start") - F.when(F.col("room_before").isNull(), F.col("move_start")).otherwise(share(F.col("room_before"), F.col("move_start"), F.col("last_move")))
    moved = rows.withColumns({"new_start": F.when(F.col("found"), start), "new_end": F.when(F.col("found"), end)})
    return moved.select(*[c for c in spans.columns if c not in ("start", "end", *AROUND)], F.col("new_start").alias("start"), F.col("new_end").alias("end"))


def compute_spans(paragraphs: DataFrame, matches: DataFrame, heard: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """paragraphs with start, end, confidence, status and word_times."""
    return refine(raw_spans(paragraphs, matches, heard, min_confidence))


def with_pace(spans: DataFrame, seconds: str = "(end - start)") -> DataFrame:
    """spans with pace_median and slow: much longer for its words than the script's other paragraphs. Counts words in n."""
    length = F.expr(seconds)
    usable = F.coalesce((F.col("n") > 0) & (length > 0), F.lit(False))
    pace = F.when(usable, length / F.col("n"))
    script = Window.partitionBy("script_id")
    out = spans.withColumns({"usable": usable, "pace": pace}).withColumns({"pace_median": F.median("pace").over(script), "n_usable": F.count(F.when(F.col("usable"), 1)).over(script)})
    slow = (F.col("n_usable") >= SLOW_PARAGRAPHS) & F.col("usable") & (length >= SLOW_SECONDS) & (F.col("pace") > SLOW_FACTOR * F.col("pace_median"))
    return out.withColumn("slow", F.coalesce(slow, F.lit(False))).drop("usable", "n_usable")


def chapter_spans(spans: DataFrame) -> DataFrame:
    """(script_id, chapter_no, first, last, start, end): bounds of each chapter's first and last found paragraph in script order."""
    found = F.col("start").isNotNull()
    return spans.groupBy("script_id", "chapter_no").agg(
        F.min_by("id", "ord").alias("first"),
        F.max_by("id", "ord").alias("last"),
        F.min_by("start", F.when(found, F.col("ord"))).alias("start"),
        F.max_by("end", F.when(found, F.col("ord"))).alias("end"),
    )


def paragraph_warnings(spans: DataFrame, missing_reason: str = "not found in the audio.") -> DataFrame:
    """(script_id, ord, seq, warning) about missing, doubtful and slow paragraphs; spans as with_pace gives them, in seconds."""
    low = F.format_string("%s: low confidence (%s). The narration may differ from the script.", "id", fixed(F.col("confidence"), 2))
    slow = F.format_string("%s: %s s for %d words, much longer than the other paragraphs. The script may be read more than once or out of order.", F.col("id"), fixed(F.col("end") - F.col("start"), 1), F.col("n"))
    texts = F.array_compact(
        F.array(
            F.when(F.col("status") == MISSING, F.concat("id", F.lit(f": {missing_reason}"))),
            F.when(F.col("status") == LOW, low),
            F.when((F.col("status") != MISSING) & F.col("slow") & F.col("start").isNotNull(), slow),
        )
    )
    return spans.select("script_id", "ord", F.posexplode(texts).alias("seq", "warning"))


def status_counts(spans: DataFrame) -> DataFrame:
    """(script_id, n_ok, n_low, n_missing)."""
    count = lambda status: F.count(F.when(F.col("status") == status, 1))
    return spans.groupBy("script_id").agg(count(OK).alias("n_ok"), count(LOW).alias("n_low"), count(MISSING).alias("n_missing"))


def exit_codes(spans: DataFrame, warnings: DataFrame, strict: bool = False) -> DataFrame:
    """(script_id, exit_code): 2 if a paragraph is missing, else 1 if strict and there are warnings, else 0."""
    missing = spans.groupBy("script_id").agg(F.bool_or(F.col("status") == MISSING).alias("missing"))
    warned = warnings.groupBy("script_id").agg(F.count("*").alias("n_warnings"))
    code = F.when(F.col("missing"), 2).when(F.lit(strict) & (F.coalesce("n_warnings", F.lit(0)) > 0), 1).otherwise(0)
    return missing.join(warned, "script_id", "left").select("script_id", code.alias("exit_code"))
