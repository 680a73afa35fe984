"""Known cases of the script operators: numbers, parsing, times, spans, layout, captions, charts and documents."""

from __future__ import annotations

import io
import json
import random
import unicodedata
import wave

import pytest
from pyspark.sql import functions as F

from linecue.errors import Unusable, usable
from linecue.functions import text, timefmt, unicode
from linecue.operators import audio, captions, charts, outputs, script, spans, timeline
from linecue.sources import files
from linecue.streaming.live import align_stream, speech_sessions


def spelled(rand, n):
    """A cardinal in words, with or without `and` and hyphens."""
    units = [None, *text.UNITS, *text.TEENS]
    if n >= 1000:
        return spelled(rand, n // 1000) + " thousand" + (f" {spelled(rand, n % 1000)}" if n % 1000 else "")
    if n >= 100:
        return f"{units[n // 100]} hundred" + (rand.choice([" and ", " "]) + spelled(rand, n % 100) if n % 100 else "")
    if n >= 20:
        return [*text.TENS][n // 10 - 2] + (rand.choice(["-", " "]) + units[n % 10] if n % 10 else "")
    return units[n] or "zero"


def normalized(spark, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, t string").repartition(2)
    return [r.w for r in df.select("i", text.normalize_text("t").alias("w")).orderBy("i").collect()]


def test_spelled_numbers_become_digits(spark):
    """Random cardinals and fractions between random words and marks."""
    rand, given, want = random.Random(4), [], []
    for _ in range(1500):
        said, words = [], []
        for _ in range(rand.randint(1, 4)):
            n = rand.choice([rand.randint(0, 30), rand.randint(0, 999), rand.randint(0, 999_999)])
            digits = [rand.randint(0, 9) for _ in range(rand.choice([0, 0, 1, 3]))]
            names = [rand.choice(["zero", "oh"]) if d == 0 else [*text.UNITS][d - 1] for d in digits]
            said += [rand.choice(["Boats", "(boats)", "boats…", "“boats”"]), spelled(rand, n) + (" point " + " ".join(names) if digits else "") + rand.choice([",", "!", ""])]
            words += ["boats", str(n) + ("." + "".join(map(str, digits)) if digits else "")]
        given.append(rand.choice([" ", "\n", "  "]).join(said))
        want.append(words)
    assert normalized(spark, given) == want


def test_numbers_equal_a_reader_of_lists(spark):
    """Any sequence of number words: the expression and the list form take the same ones together."""
    rand = random.Random(9)
    rows = [" ".join(rand.choices(["boats", "5", *text.NUMBER_WORDS], [6, 3, *[1] * (len(text.NUMBER_WORDS) - 4), 9, 9, 9, 9], k=rand.randint(0, 12))) for _ in range(4000)]
    assert normalized(spark, rows) == [[w for w, _, _ in text.merged_list(r.split())] for r in rows]


def test_texts_fold_as_in_python(spark):
    """All code points between others, and random sequences of characters that melt together or change places."""
    rand, every = random.Random(3), [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rows = ["-".join(every[i : i + 60]) for i in range(0, len(every), 60)]
    seconds, composed = sorted(unicode._seconds()), [c for c in every if unicodedata.decomposition(c)]
    for _ in range(5000):
        pick = lambda: rand.choice([rand.choice("aAeouİΣßｱ "), rand.choice(seconds), rand.choice(seconds), rand.choice(composed), chr(rand.randint(0x1100, 0x11FF)), chr(rand.randint(0xAC00, 0xD7A3)), rand.choice("\u3099\u0323\u0301\u0307")])
        rows.append("".join(pick() for _ in range(rand.randint(1, 9))))
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, t string").repartition(4)
    got = {r.i: r.f for r in df.select("i", unicode.fold_case(F.col("t")).alias("f")).collect()}
    assert [i for i, r in enumerate(rows) if got[i] != unicodedata.normalize("NFKC", r).casefold()] == []


def test_words_fold_as_in_the_tasks(spark):
    rand = random.Random(8)
    rows = ["".join(rand.choices("ab1٣.,’'ʼ-–/ \u00a0\n\x1f€éß½", k=rand.randint(0, 12))) for _ in range(4000)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, t string")
    got = {r.i: r.f for r in df.select("i", text.fold_text(F.col("t")).alias("f")).collect()}
    assert [(r, got[i], text.fold(r)) for i, r in enumerate(rows) if got[i] != text.fold(r)] == []


def test_marks_are_kept_or_dropped_by_their_neighbours(spark):
    rand = random.Random(2)
    for mark, between, alone in [("'", "'", ""), ("’", "'", ""), (".", ".", ""), (",", "", ""), ("/", " ", " "), ("–", " ", " "), ("€", "", ""), ("“", "", "")]:
        a, b = rand.sample(["12", "345", "6"], 2)
        got = normalized(spark, [f"{a}{mark}{b}", f"{mark} {a}{mark} {b}", f"Ab{mark}cD"])
        inside = between if mark != "." else ""
        assert got == [f"{a}{between}{b}".split(), [a, b], f"ab{inside}cd".split()]
    assert normalized(spark, [None, "", "?! …", "ﬁn ４２ STRASSE straße", "7 .5"]) == [[], [], [], ["fin", "42", "strasse", "strasse"], ["7.5"]]


def test_numbers_without_bound_stop_no_script(spark):
    lines = "P7 - a\n> a\nP99999999999 - b\n> b\nP" + "9" * 60 + " - c\n> c\nP012 - d\n> d\n"
    rows = script.paragraphs(lines_of(spark, lines)).orderBy("ord").collect()
    assert [(r.id, r.number) for r in rows] == [("P7", 7), ("P99999999999", None), ("P" + "9" * 60, None), ("P12", 12)]
    assert [(r.line, r.message) for r in script.problems(lines_of(spark, lines)).collect()] == [(7, f"P12 comes after P{'9' * 60} but numbers must increase")]


def test_timed_words(spark):
    rows = [(1, 0, 0, "$18", 0.2, 0.7), (1, 0, 1, ".25.", 0.7, 1.5), (1, 0, 2, "side-by-side", 3.0, 3.6), (1, 0, 3, "twenty", 4.0, 4.5), (1, 0, 4, "six", 4.5, 5.0), (1, 0, 5, "--", 5.0, 5.1)]
    got = timeline.normalize_words(spark.createDataFrame(rows, "script_id long, part_no int, idx int, text string, start double, end double")).orderBy("idx").collect()
    assert [(r.word, round(r.start, 2), round(r.end, 2)) for r in got] == [("18.25", 0.2, 1.5), ("side", 3.0, 3.2), ("by", 3.2, 3.4), ("side", 3.4, 3.6), ("26", 4.0, 5.0)]


def test_clean_text_and_names(spark):
    cases = {"Marks [one [two] three] go, [this": "Marks go, [this", "See [here](https://x.org) too": "See [here](https://x.org) too", "*a* <!-- b\nc --> `d`_e_ [1][2]": "a de", "": "", "[" * 40 + "x" + "]" * 40 + " y": "y", "] [a] [b [c](d) e": "] [b [c](d) e"}
    rows = spark.createDataFrame(list(cases.items()), "t string, want string").select("want", text.clean_text(F.col("t")).alias("got")).collect()
    assert all(r.got == r.want for r in rows), rows
    names = {"p8_take2.mp3": "P8", "P008.wav": "P8", "xp8.wav": None, "a P12b.wav": "P12", "take.wav": None, "P1-P2.wav": "P1"}
    rows = spark.createDataFrame(list(names.items()), "n string, want string").select("n", "want", text.paragraph_id_in_name(F.col("n")).alias("got")).collect()
    assert all(r.got == r.want for r in rows), rows
    listed = spark.createDataFrame([(1, n) for n in ["b10.wav", "B2.WAV", "b1.mp3", "x.txt"]], "script_id long, name string")
    assert [r.name for r in audio.audio_files(listed).orderBy("file_ord").collect()] == ["b1.mp3", "B2.WAV", "b10.wav"]


def test_time_texts(spark):
    row = spark.range(1).select(
        *(timefmt.format_time(F.lit(x)).alias(f"t{i}") for i, x in enumerate([59.96, 3599.96, 0.0, -1.0])),
        timefmt.format_srt_time(F.lit(1.2346)).alias("srt"),
        timefmt.timecode(timefmt.frame_of(F.lit(60.0), timefmt.timebase(29.97, "00:00:00:00")), timefmt.timebase(29.97, "00:00:00:00")).alias("code"),
        *(timefmt.parse_time(F.lit(x)).alias(f"p{i}") for i, x in enumerate(["01:02.5", "1:00:00", "61:00", "1:2", "00:60"])),
        timefmt.short_number(F.lit(13.4)).alias("n"),
        timefmt.short_number(F.lit(3.0)).alias("m"),
    ).first()
    assert tuple(row) == ("01:00.0", "1:00:00.0", "00:00.0", None, "00:00:01,235", "00:00:59:28", 62.5, 3600.0, None, None, None, "13.4", "3.0")
    for wrong in [(26, "01:00:00:00"), (30, "1:0"), (24, "00:00:00:24")]:
        with pytest.raises(Unusable):
            timefmt.timebase(*wrong)
    assert timefmt.timebase() == (30.0, 30, 108_000)


def lines_of(spark, *texts):
    return script.script_lines(spark.createDataFrame(list(enumerate(texts)), "script_id long, text string"))


GOOD = "﻿# Top\n## 1. Bir / 2. First\nP1 — x\n\n> Hello *there*. [1]\n<!-- pause: 1.5 -->\n**P02**: y\r\n> Two\n> lines <!-- chart: a-b, sequence -->\n## Last\n## Bir / First\nP3. z\n> Three <!-- chart: a-b, sequence -->"


def test_scripts(spark):
    rows = script.paragraphs(lines_of(spark, GOOD)).orderBy("ord").collect()
    assert [(r.chapter_no, r.chapter, r.id, r.line, r.text, r.pause_after) for r in rows] == [(0, "First", "P1", 3, "Hello there.", 1.5), (0, "First", "P2", 7, "Two lines", None), (1, "First", "P3", 12, "Three", None)]
    assert [[(c.id, c.sequence, c.line) for c in r.charts] for r in rows] == [[], [("a-b", True, 9)], [("a-b", True, 13)]]
    assert script.problems(lines_of(spark, GOOD)).count() == 0
    made = charts.charts_of_tags(script.paragraphs(lines_of(spark, GOOD)))
    assert [(r.id, r.paragraphs, r.sequence) for r in made.collect()] == [("a-b", ["P2", "P3"], True)]
    assert charts.tag_problems(made).count() == 0
    inline = script.paragraphs(lines_of(spark, "P1 - one\ntwo\n\nthree\nP2: four\n> five"), script.INLINE).orderBy("ord").collect()
    assert [(r.chapter, r.text) for r in inline] == [("Intro", "one two"), ("Intro", "four")]


def test_script_problems(spark):
    bad = "<!-- chart: a -->\nP1 - a\nP2 - b\n> [x]\nP2 - c\n> c <!-- chart: A --> <!-- chart: a,b --> <!-- chart: , --> <!-- chart: a --><!-- chart: a -->\nP3 d\n##\nP1: e\n> e <!-- pause: 0 --> <!-- pause: 2 --> <!-- pause: 3 -->\nP0: f\n> f <!-- pause: 1 -->"
    got = [(r.line, r.message.split(" (use")[0]) for r in script.problems(lines_of(spark, bad, "text")).where("script_id = 0").orderBy("line", "seq", "message").collect()]
    assert got == [
        (1, "the chart tag is not under a paragraph"),
        (2, "P1 has no blockquote"),
        (3, "P2 has no text to align (empty after cleaning)"),
        (5, "P2 is repeated (first at line 3)"),
        (6, "chart 'a' is tagged twice on P2"),
        (6, "chart id 'A' may only use a-z, 0-9 and '-'"),
        (6, "invalid chart tag"),
        (6, "unknown chart option 'b' (the only option is 'sequence')"),
        (7, "P3 is missing a separator after the identifier"),
        (8, "chapter heading has no title"),
        (9, "P1 is repeated (first at line 2)"),
        (10, "P1 has two pause tags (first at line 10)"),
        (10, "invalid pause tag"),
        (11, "P0 comes after P1 but numbers must increase"),
        (12, "P0 is the last paragraph, no paragraph follows its pause"),
    ]
    assert [(r.line, r.message) for r in script.problems(lines_of(spark, "text")).collect()] == [(None, "no paragraphs found")]
    with pytest.raises(Unusable, match="script 0, line 1: the chart tag"):
        usable(script.paragraphs(lines_of(spark, bad)), script.problems(lines_of(spark, bad)))


def test_snap(spark):
    seg = spark.createDataFrame([(1, 0, 10.0, 12.0), (1, 0, 14.0, 15.0)], "script_id long, part_no int, start double, end double")
    words = [(9.9, 10.5), (11.5, 12.2), (12.0, 13.0), (14.3, 14.6), (14.8, 15.03), (20.0, 21.0)]
    rows = spark.createDataFrame([(1, 0, i, a, b) for i, (a, b) in enumerate(words)], "script_id long, part_no int, idx int, start double, end double")
    got = [(round(r.start, 2), round(r.end, 2)) for r in timeline.snap_to_speech(rows, seg).orderBy("idx").collect()]
    assert got == [(10.0, 10.5), (11.5, 12.0), (12.0, 13.0), (14.0, 14.6), (14.8, 15.03), (20.0, 21.0)]


def test_layout_and_timeline(spark):
    rows = [(1, i, f"P{i + 1}", c, 1000.0, 0, n) for i, (c, n) in enumerate([(0, 1000), (0, 2000), (1, 500)])]
    entries = spark.createDataFrame(rows, "script_id long, ord int, id string, chapter_no int, rate double, first_frame long, last_frame long")
    none = spark.createDataFrame([], "script_id long, id string, pause double")
    assert [r.offset_frames for r in audio.join_layout(entries, none).orderBy("ord").collect()] == [0, 1600, 4800]
    pauses = spark.createDataFrame([(1, "P1", 4.0), (1, "P3", 1.0), (1, "P9", 1.0)], "script_id long, id string, pause double")
    assert [r.offset_frames for r in audio.join_layout(entries, pauses).orderBy("ord").collect()] == [0, 5000, 8200]
    assert [r.warning for r in audio.unused_pauses(entries, pauses, entries).collect()] == ["P3: pause of 1.0 s ignored, no audio file follows it."]
    parts = spark.createDataFrame([(1, i, x) for i, x in enumerate([10.0, 20.0, 5.0])], "script_id long, part_no int, duration double")
    assert [r.offset for r in timeline.build_timeline(parts, 0.5).orderBy("part_no").collect()] == [0, 10.5, 31]
    assert timeline.total_duration(parts, 0.5).first().total_duration == 36


def test_refinement(spark):
    """Two words at either side of a bound are unmatched, and the two free words between are shared."""
    words = [(1, i, i * 0.5, i * 0.5 + 0.4) for i in range(8)]
    heard = spark.createDataFrame(words, "script_id long, idx int, start double, end double")
    matched = [(0, 0, 0), (0, 1, 1), (0, 2, 2), (0, 3, None), (0, 4, None), (1, 0, None), (1, 1, None), (1, 2, 5), (1, 3, 6), (1, 4, 7)]
    matches = spark.createDataFrame([(1, o, p, h, None if h is None else 1.0) for o, p, h in matched], "script_id long, ord int, pos int, heard_idx int, similarity double")
    paragraphs = spark.createDataFrame([(1, 0, "P1"), (1, 1, "P2"), (1, 2, "P3")], "script_id long, ord int, id string")
    got = spans.compute_spans(paragraphs, matches, heard, 0.5).orderBy("ord").collect()
    assert [(r.status, r.confidence) for r in got] == [("ok", 0.6), ("ok", 0.6), ("missing", 0.0)]
    assert (round(got[0].end, 3), round(got[1].start, 3), got[2].start) == (1.95, 1.95, None)
    assert [None if w is None else w.start for w in got[0].word_times] == [0.0, 0.5, 1.0, None, None]


def test_pace(spark):
    rows = [(1, f"P{i}", n, 0.0, s) for i, (n, s) in enumerate([(10, 4.0), (10, 4.2), (10, 4.1), (12, 730.0)])]
    got = spans.with_pace(spark.createDataFrame(rows, "script_id long, id string, n int, start double, end double")).where("slow").collect()
    assert [r.id for r in got] == ["P3"]


def test_captions(spark):
    sentence = "This is a rather long sentence that goes on and on, with a pause in the middle, until nobody can read it on two lines anymore."
    tokens = sentence.split()
    times = [(i * 0.4, i * 0.4 + 0.3) for i in range(len(tokens))]
    pieces = captions.cut(tokens, times)
    assert [a for a, _ in pieces] == [0, *(b for _, b in pieces[:-1])] and pieces[-1][1] == len(tokens)
    assert all(captions.two_lines(tokens[a:b]) for a, b in pieces)
    assert captions.two_lines(["x" * 50]) == "x" * 50 and captions.two_lines(["x" * 50, "y"]) is None
    assert captions.tidy([[0.0, 0.4, "a", "P1"], [0.4, 3.0, "b", "P1"], [3.0, 3.2, "c", "P2"]]) == [[0.0, 3.0, "a b", "P1"], [3.0, 4.0, "c", "P2"]]
    time = "struct<start:double,end:double>"
    rows = spark.createDataFrame([(1, 0, "P1", "Hello — big world.", 1.0, 4.0, [(1.0, 1.5), None, (3.0, 3.5)])], f"script_id long, ord int, id string, text string, start double, end double, word_times array<{time}>")
    got = captions.token_times(rows).orderBy("tok").collect()
    assert [(round(r.start, 3), round(r.end, 3)) for r in got] == [(1.0, 1.5), (1.5, 2.0), (2.0, 3.0), (3.0, 3.5)]
    assert captions.srt_text(captions.build_captions(captions.token_times(rows))).first().text == "1\n00:00:01,000 --> 00:00:04,000\nHello — big world.\n"


SPANS = "script_id long, ord int, id string, start double, end double, confidence double, status string"


def test_charts(spark):
    rows = [("P1", 0.0, 10.0), ("P2", 10.6, 21.1), ("P3", 21.9, 35.0), ("P4", 36.0, 49.5), ("P5", 50.0, 61.0), ("P6", 62.0, 75.6), ("P7", 76.1, 89.0), ("P8", 89.5, 101.0)]
    found = spark.createDataFrame([(1, i, p, a, b, 1.0, "ok") for i, (p, a, b) in enumerate(rows)], SPANS)
    document = {"version": 1, "charts": {"peak": {"paragraphs": ["P2"]}, "growth": {"paragraphs": ["P3", "P4"]}, "fall": {"paragraphs": ["P6", "P7", "P8"], "sequence": True}}}
    maps = lambda *documents: spark.createDataFrame([(i + 1, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)], "script_id long, text string")
    made = charts.charts_of_maps(maps(document))
    timed = {r.id: r for r in charts.chart_timing(made, found).collect()}
    assert (timed["peak"].start, timed["peak"].duration) == (10.6, 10.5) and timed["growth"].duration == 27.6
    assert timed["fall"].step_duration == 13.4 and [c.duration for c in timed["fall"].clips] == [14.1, 13.4, 11.5]
    assert charts.timing_text(charts.chart_timing(made, found)).first().text.endswith("    clips:\n      - { n: 1, start: 62.0, duration: 14.1 }\n      - { n: 2, start: 76.1, duration: 13.4 }\n      - { n: 3, start: 89.5, duration: 11.5 }\n")
    wrong = {"version": 2, "charts": {"A": {"paragraphs": ["P1", "P1"], "x": 1}, "con": 3, "s": {"paragraphs": ["P1"], "sequence": True}, "t": {"sequence": 1}}}
    found = charts.map_problems(maps(wrong, [], {"version": 1, "charts": [1]}, {"charts": {}}, "no json", document)).orderBy("script_id", "seq").collect()
    assert [p.message for p in found if p.script_id == 1] == [
        "version must be 1, got 2",
        "charts.A: the id may only use a-z, 0-9 and '-'",
        "charts.A: unknown field 'x' (use paragraphs, sequence)",
        "charts.A: P1 is listed twice",
        "charts.con: 'con' is a name Windows reserves",
        "charts.con: must have 'paragraphs' (and optionally 'sequence')",
        "charts.s: a sequence needs 2 to 8 paragraphs, got 1",
        "charts.t: paragraphs is required",
        "charts.t.sequence: must be true or false",
    ]
    assert [(p.script_id, p.message[:10]) for p in found if p.script_id > 1] == [(2, "the file m"), (3, "its charts"), (4, "version is"), (4, "charts: at"), (5, "the file m")]
    with pytest.raises(Unusable):
        charts.charts_of_maps(maps(wrong))
    assert [r.chart_ord for r in charts.merged(made, made).orderBy("chart_ord").collect()] == list(range(6))


def test_documents(spark):
    found = spark.createDataFrame([(1, 0, "P1", 0.5, 2.25, 1.0, "ok"), (1, 1, "P2", None, None, 0.0, "missing")], SPANS).withColumn("chapter", F.lit('A "b", c'))
    rows = outputs.timing_rows(found)
    assert [r.line for r in outputs.timing_csv(rows).orderBy("ord").collect()][1:] == ['P1,"A ""b"", c",0.5,2.25,1.75,1.0,ok', 'P2,"A ""b"", c",,,,0.0,missing']
    chapter = spark.createDataFrame([(1, 0, "A", "P1", "P2", 0.5, 2.25)], "script_id long, chapter_no int, title string, first string, last string, start double, end double")
    runs = spark.createDataFrame([(1, "t", "s.md", "parts", 0.0, 9.0)], "script_id long, tool string, script string, mode string, offset double, total_duration double")
    parts = spark.createDataFrame([(1, 0, "a.wav", 0.0, 9.0)], "script_id long, part_no int, file string, offset double, duration double")
    none = spark.createDataFrame([], "script_id long, seq int, warning string")
    made = outputs.timing_document(runs, parts, chapter, rows, none)
    document = json.loads(made.first().document)
    assert document["paragraphs"][1]["start"] is None and document["warnings"] == [] and document["audio"][0]["file"] == "a.wav"
    others = spark.createDataFrame([("{",), ("{}",), ('{"version": 7, "paragraphs": []}',)], "value string")
    got = files.timing_of(made.select(F.col("document").alias("value")).union(others)).collect()
    assert [r.problem and r.problem[:27] for r in got] == [None, "The timing file is not vali", "This is not a timing file", "The timing file has version"]
    assert got[0].document.paragraphs[0].end == 2.25
    marked = outputs.markers(found, timefmt.timebase())
    assert "P1 |D:1" in outputs.edl_text(marked, runs.select("script_id", F.col("script").alias("title"))).first().text


def tone(value: int, frames: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as wav:
        wav.setnchannels(1)
        wav.setsampwidth(1)
        wav.setframerate(1000)
        wav.writeframes(bytes([value]) * frames)
    return out.getvalue()


def test_audio_and_script_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 3, 0, bytearray(tone(1, 5))), (1, 1, 4, 5, bytearray(tone(2, 5)))], "script_id long, first_frame long, last_frame long, offset_frames long, content binary")
    joined = files.join_wavs(rows).first().content
    with wave.open(io.BytesIO(joined)) as wav:
        assert wav.readframes(99) == b"\1\1\1\x80\x80\2\2\2"
    info = files.wav_info(rows.select("content").union(spark.createDataFrame([(bytearray(b"no"),)], "content binary"))).collect()
    assert [(r.channels, r.width, r.rate, r.frames) for r in info] == [(1, 1, 1000, 5)] * 2 + [(None,) * 4]
    (tmp_path / "a.md").write_bytes("﻿P1 — é".encode())
    (tmp_path / "b.md").write_bytes(b"\xff\xfe")
    got = {r.path[-4:]: r for r in files.read_scripts(spark, str(tmp_path)).collect()}
    assert got["a.md"].problem is None and got["b.md"].text is None and "UTF-8" in got["b.md"].problem


def test_durations_and_outputs(spark, tmp_path):
    rows = spark.createDataFrame([(1, bytearray(tone(1, 1500))), (2, bytearray(tone(1, 0))), (3, bytearray(b"x")), (4, None)], "script_id long, content binary")
    got = files.durations(rows).orderBy("script_id").collect()
    assert [(r.duration, r.problem) for r in got] == [(1.5, None), (None, "the file holds no audio"), (None, "the file is no PCM WAV"), (None, "the file can't be read")]
    lines = spark.createDataFrame([(1, 1, "P1,é"), (1, 0, "id,chapter")], "script_id long, ord int, line string")
    texts = {"csv": outputs.csv_text(lines), "srt": spark.createDataFrame([(1, "1\n"), (2, "")], "script_id long, text string")}
    made = files.write_outputs(texts, str(tmp_path / "out"), "srt, csv,edl")
    assert [m[-3:] for m in made] == ["srt", "csv"]
    read = lambda kind: [p.read_bytes() for p in (tmp_path / "out" / kind).rglob("part-*")]
    assert read("csv") == ["\ufeffid,chapter\r\nP1,é\r\n".encode()] and read("srt") == [b"1\n"]
    with pytest.raises(Unusable, match="no format doc"):
        files.write_outputs(texts, str(tmp_path / "out"), "csv,doc")


def test_files_of_a_script(spark):
    rows = spark.createDataFrame([(1, 0, "p1.wav", "P1"), (1, 1, "take P1.wav", "P1"), (1, 2, "p2.wav", "P2"), (2, 0, "x.wav", None)], "script_id long, file_ord int, name string, para_id string")
    assert [r.message for r in audio.repeated_files(rows).collect()] == ["P1 has two audio files: p1.wav and take P1.wav"]
    kinds = spark.createDataFrame([(1, 0, "a.wav", 1, 2, 8000), (1, 1, "b.wav", 1, 2, 8000), (1, 2, "c.wav", 2, 2, 44100)], "script_id long, ord int, name string, channels int, width int, rate int")
    assert [r.message for r in audio.format_problems(kinds).collect()] == ["c.wav is 44100 Hz, 16-bit, 2 channel(s), but a.wav is 8000 Hz, 16-bit, 1 channel(s); the files to join must all have one format"]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.0), (1, 0.2), (1, 5.0), (2, 0.1)], "key long, t double").withColumn("at", F.timestamp_seconds("t"))
    assert sorted((r.key, r.n) for r in speech_sessions(rows, "key", "at").collect()) == [(1, 1), (1, 2), (2, 1)]
    spark.createDataFrame([(1, 0, "b")], "script_id long, idx int, word string").write.parquet(str(tmp_path / "in"))
    heard = spark.readStream.schema("script_id long, idx int, word string").parquet(str(tmp_path / "in"))
    script_words = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "script_id long, gpos int, word string")
    found = []
    align_stream(heard, script_words, lambda df, _: found.extend(map(tuple, df.collect())), str(tmp_path / "check")).awaitTermination(120)
    assert sorted(found) == [(1, 0, None, None), (1, 1, 0, 1.0)]
