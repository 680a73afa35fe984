"""Scripts, words, timing documents and PCM audio as DataFrames, and single text files as sinks."""

from __future__ import annotations

import io
import wave

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from linecue.errors import Unusable

TIMING = (
    "version int, tool string, script string, mode string, offset double, total_duration double, "
    "audio array<struct<file:string,offset:double,duration:double>>, "
    "chapters array<struct<title:string,start:double,end:double,first:string,last:string>>, "
    "paragraphs array<struct<id:string,chapter:string,start:double,end:double,duration:double,confidence:double,status:string>>, "
    "warnings array<string>"
)
TIMING_VERSION = 1
#: What write_outputs can write.
FORMATS = ("json", "csv", "chapters", "edl", "srt")


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    """(script_id, path, text, problem): a row a file, a hash of its path as id; text is null where it isn't UTF-8."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    good = F.is_valid_utf8(F.col("content").cast("string"))
    return files.select(F.xxhash64("path").alias("script_id"), "path", F.when(good, F.col("content").cast("string")).alias("text"), F.when(~good, "Script file is not valid UTF-8").alias("problem"))


def recognized_words(segments: DataFrame) -> DataFrame:
    """(script_id, part_no, idx, text, start, end) from recognizer output: script_id, part_no, seq, words array<struct<text,start,end>>; blank words go."""
    rows = segments.select("script_id", "part_no", "seq", F.posexplode("words").alias("k", "w")).select("script_id", "part_no", "seq", "k", F.trim("w.text").alias("text"), "w.start", "w.end").where("text <> ''")
    return rows.withColumn("idx", F.expr("cast(row_number() over (partition by script_id, part_no order by seq, k) - 1 as int)")).drop("seq", "k")


def speech_bounds(segments: DataFrame) -> DataFrame:
    """(script_id, part_no, start, end): the first and last speech of each part."""
    return segments.groupBy("script_id", "part_no").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def read_timing(spark: SparkSession, path: str) -> DataFrame:
    """(path, document struct, problem): a row a timing document; problem says why one can't be used."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return timing_of(rows)


def timing_of(rows: DataFrame) -> DataFrame:
    """rows with value (JSON text) as document and problem instead."""
    parsed = F.from_json("value", TIMING, {"mode": "PERMISSIVE"})
    is_json = F.try_parse_json("value").isNotNull()
    other = F.col("document").isNull() | F.col("document.version").isNull() | F.col("document.paragraphs").isNull()
    out = rows.withColumns({"document": parsed, "is_json": F.coalesce(is_json, F.lit(False))})
    problem = F.when(~F.col("is_json"), "The timing file is not valid JSON").when(other, "This is not a timing file").when(F.col("document.version") != TIMING_VERSION, F.format_string(f"The timing file has version %d; this version reads version {TIMING_VERSION}", "document.version"))
    return out.withColumn("problem", problem).drop("value", "is_json")


def wav_info(files: DataFrame) -> DataFrame:
    """files (content binary) with channels, width, rate, frames; null where the content is no PCM WAV."""

    @pandas_udf("struct<channels:int,width:int,rate:int,frames:long>")
    def info(content: pd.Series) -> pd.DataFrame:
        def of(data: bytes) -> tuple:
            try:
                with wave.open(io.BytesIO(data)) as wav:
                    return wav.getnchannels(), wav.getsampwidth(), wav.getframerate(), wav.getnframes()
            except (wave.Error, EOFError, TypeError):
                return None, None, None, None

        return pd.DataFrame(content.map(of).tolist(), columns=["channels", "width", "rate", "frames"]).astype("Int64")

    return files.select("*", info("content").alias("i")).select(*files.columns, "i.*")


def durations(files: DataFrame) -> DataFrame:
    """files (content binary) with duration in seconds and problem, which says why there is none."""
    found = wav_info(files)
    problem = F.when(F.col("content").isNull(), "the file can't be read").when(F.col("rate").isNull(), "the file is no PCM WAV").when(F.col("frames") == 0, "the file holds no audio")
    rows = found.withColumns({"duration": F.when(F.col("frames") > 0, F.col("frames") / F.col("rate")), "problem": problem})
    return rows.select(*files.columns, "duration", "problem")


def join_wavs(layout: DataFrame) -> DataFrame:
    """(script_id, content): the joined PCM file of each script.

    layout: script_id, first_frame, last_frame, offset_frames, content. A
    script's narration is one file and so one task's work.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out, written = io.BytesIO(), 0
        with wave.open(out, "wb") as target:
            for k, r in enumerate(rows.sort_values("offset_frames").itertuples()):
                with wave.open(io.BytesIO(r.content)) as source:
                    if k == 0:
                        target.setparams(source.getparams()._replace(nframes=0))
                        silence = (b"\x80" if source.getsampwidth() == 1 else b"\0") * source.getsampwidth() * source.getnchannels()
                    target.writeframes(silence * int(r.offset_frames - written))
                    source.setpos(int(r.first_frame))
                    target.writeframes(source.readframes(int(r.last_frame - r.first_frame)))
                written = r.offset_frames + r.last_frame - r.first_frame
        return pd.DataFrame({"script_id": [rows.script_id.iat[0]], "content": [out.getvalue()]})

    return layout.select("script_id", "first_frame", "last_frame", "offset_frames", "content").groupBy("script_id").applyInPandas(run, "script_id long, content binary")


def write_texts(texts: DataFrame, path: str) -> None:
    """Texts (script_id, text) in folders script_id=N of path, as they are but for a line end at the end of those without one."""
    bodies = texts.select("script_id", F.regexp_replace("text", r"\n\z", "").alias("text"))
    bodies.write.mode("overwrite").partitionBy("script_id").option("lineSep", "\n").text(path)


def write_outputs(texts: dict[str, DataFrame], path: str, formats: str = "json,csv") -> list[str]:
    """Writes the texts (script_id, text) of the chosen formats below path and returns the folders; Unusable for a format that FORMATS doesn't have.

    Scripts without a text of a format, and null or empty texts, have no file.
    """
    chosen = [f.strip() for f in formats.split(",") if f.strip()]
    wrong = [f for f in chosen if f not in FORMATS]
    if wrong:
        raise Unusable([f"there is no format {f}, only {', '.join(FORMATS)}" for f in wrong])
    folders = [f"{path.rstrip('/')}/{f}" for f in dict.fromkeys(chosen) if f in texts]
    for folder in folders:
        write_texts(texts[folder.rpartition("/")[2]].where("text <> ''"), folder)
    return folders
