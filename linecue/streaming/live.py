"""Words that arrive as a stream: stretches of speech by session windows, and alignment batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linecue.operators.alignment import align_words


def speech_sessions(events: DataFrame, key: str, at: str, silence: str = "300 milliseconds", late: str = "1 minute") -> DataFrame:
    """(key, start, end, n): stretches of events less than `silence` apart; a stretch is final once `late` has passed."""
    stretch = F.session_window(at, silence)
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(key, stretch.alias("stretch")).agg(F.count("*").alias("n")).select(key, F.col("stretch.start").alias("start"), F.col("stretch.end").alias("end"), "n")


def align_stream(heard: DataFrame, script_words: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Aligns the scripts whose words are complete in a batch and hands the matches to sink."""

    def batch(rows: DataFrame, number: int) -> None:
        ids = rows.select("script_id").distinct()
        sink(align_words(script_words.join(ids, "script_id", "left_semi"), rows), number)

    return heard.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
