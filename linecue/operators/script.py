"""Numbered Markdown scripts to paragraphs, chart tags, pauses and problems, by expressions and windows.

lines: script_id, line (from 1), text. A line is a paragraph's first line, an
identifier without separator, a heading, a quote, blank or text: the first that
fits. The first three end the paragraph above them. All problems are found at
once; a script is fit for use if it has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linecue.functions.text import clean_text

QUOTE, INLINE = "quote", "inline"
INTRO = "Intro"
# The shapes of script lines and tags.
_NAME = r"^(?:(\*\*|__|\*)[Pp](\d+)\1|[Pp](\d+))"
PARAGRAPH = _NAME + r"[ \t]*[—–\-:.][ \t]*(.*)$"
UNSEPARATED = _NAME + r"(?:\s|$)"
HEADING = r"^(#{1,6})(?:[ \t]+(.*?))?[ \t]*$"
QUOTED = r"^>[ \t]?(.*)$"
CHART_TAG = r"(?is)<!--\s*chart\s*:(.*?)-->"
PAUSE_TAG = r"(?is)<!--\s*pause\s*:(.*?)-->"
CHART_USAGE = "use <!-- chart: tides-by-month --> or <!-- chart: tides-by-month, sequence -->"
PAUSE_USAGE = "use <!-- pause: 0.75 -->, a number of seconds above 0"


def script_lines(scripts: DataFrame) -> DataFrame:
    """Lines of whole scripts (script_id, text): cut at CRLF, CR or LF, without a byte order mark."""
    body = F.regexp_replace("text", "^﻿", "")
    return scripts.select("script_id", F.posexplode(F.split(body, r"\r\n|\r|\n")).alias("at", "text")).select("script_id", (F.col("at") + 1).alias("line"), "text")


def line_kinds(lines: DataFrame) -> DataFrame:
    """lines with kind, digits and number (of paragraphs; null beyond an int's range), level and title text (of headings) and body (what the line says)."""
    text = F.col("text")
    part = lambda shape, k: F.regexp_extract(text, shape, k)
    digits = lambda shape: F.regexp_replace(F.concat(part(shape, 2), part(shape, 3)), r"^0+(?=\d)", "")
    blank = text.rlike(r"(?U)^\s*$")
    kind = F.when(text.rlike(PARAGRAPH), "paragraph").when(text.rlike(UNSEPARATED), "unseparated").when(text.rlike(HEADING), "heading").when(text.rlike(QUOTED), "quote").when(blank, "blank").otherwise("text")
    out = lines.withColumn("kind", kind)
    out = out.withColumns(
        {
            "digits": F.when(F.col("kind") == "paragraph", digits(PARAGRAPH)).when(F.col("kind") == "unseparated", digits(UNSEPARATED)),
            "level": F.when(F.col("kind") == "heading", F.length(part(HEADING, 1))),
            "body": F.when(F.col("kind") == "paragraph", part(PARAGRAPH, 4)).when(F.col("kind") == "heading", F.coalesce(part(HEADING, 2), F.lit(""))).when(F.col("kind") == "quote", part(QUOTED, 1)).otherwise(text),
        }
    )
    return out.withColumn("number", F.col("digits").try_cast("int"))


def chapter_title(heading: Column, mode: str = QUOTE) -> Column:
    """A heading's title: its last part at ` / ` for quotes, the first for inline text, without a leading number."""
    parts = F.split(F.trim(heading), " / ", -1)
    return F.regexp_replace(F.trim(F.element_at(parts, -1 if mode == QUOTE else 1)), r"^\d+\.(?:\s+|$)", "")


def outlined(lines: DataFrame) -> DataFrame:
    """line_kinds with chapter_key (headings of level 2 and 3 so far) and owner (first line of the paragraph that a line is in, or null)."""
    so_far = Window.partitionBy("script_id").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bound = F.col("kind").isin("paragraph", "unseparated", "heading")
    last = F.last(F.when(bound, F.struct("line", "kind")), ignorenulls=True).over(so_far)
    opens = (F.col("kind") == "heading") & F.col("level").isin(2, 3)
    return line_kinds(lines).withColumns({"chapter_key": F.sum(F.when(opens, 1).otherwise(0)).over(so_far), "last_bound": last}).withColumn("owner", F.when(F.col("last_bound.kind") == "paragraph", F.col("last_bound.line"))).drop("last_bound")


def _texts(outline: DataFrame, mode: str) -> DataFrame:
    """(script_id, owner, raw): the lines of each paragraph that count, joined; raw is null where a quote is asked for and there is none."""
    own = Window.partitionBy("script_id", "owner").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = F.col("kind") == "quote"
    rows = outline.where("owner is not null")
    if mode == INLINE:
        rows = rows.withColumn("ended", F.count(F.when(F.col("kind").isin("blank", "quote"), 1)).over(own))
        counts = F.col("kind").isin("paragraph", "text") & (F.col("ended") == 0)
    picked = F.sort_array(F.collect_list(F.when(counts, F.struct("line", "body"))))
    return rows.groupBy("script_id", "owner").agg(F.when(F.size(picked) > 0, F.array_join(F.transform(picked, lambda x: x["body"]), " ")).alias("raw"))


_EVENTS = "array<struct<event:string,seq:int,key:string,problem:string,value:string>>"


def _chart_parts(content: Column) -> tuple[Column, Column, Column]:
    """Name, option and number of parts of a chart tag."""
    parts = F.transform(F.split(content, ",", -1), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.size(parts)


def _chart_problem(parts: tuple[Column, Column, Column], owner: Column) -> Column:
    name, option, n = parts
    return (
        F.when(owner.isNull(), "the chart tag is not under a paragraph")
        .when((name == "") | (n > 2), f"invalid chart tag ({CHART_USAGE})")
        .when(~name.rlike("^[a-z0-9-]+$"), F.format_string("chart id '%s' may only use a-z, 0-9 and '-'", name))
        .when((n == 2) & (F.lower(option) != "sequence"), F.format_string("unknown chart option '%s' (the only option is 'sequence')", option))
    )


def _seconds(content: Column) -> Column:
    """The value of a pause tag, or null."""
    seconds = F.regexp_replace(content, r"^\s+|\s+$", "")
    return F.when(seconds.rlike(r"^\d+(?:\.\d+)?$"), seconds.cast("double"))


def _pause_problem(value: Column, owner: Column) -> Column:
    return F.when(owner.isNull(), "the pause tag is not under a paragraph").when(F.coalesce(value, F.lit(0.0)) <= 0, f"invalid pause tag ({PAUSE_USAGE})")


def chart_tags(outline: DataFrame) -> DataFrame:
    """(script_id, owner, line, seq, id, sequence, problem) of all chart tags; problem is null for good ones."""
    rows = outline.select("script_id", "owner", "line", F.posexplode(F.regexp_extract_all(F.col("text"), F.lit(CHART_TAG), F.lit(1))).alias("seq", "content"))
    name, option, n = _chart_parts(F.col("content"))
    problem = _chart_problem((name, option, n), F.col("owner"))
    rows = rows.select("script_id", "owner", "line", "seq", name.alias("id"), (n == 2).alias("sequence"), problem.alias("problem"))
    again = F.row_number().over(Window.partitionBy("script_id", "owner", "id", F.col("problem").isNull()).orderBy("line", "seq")) > 1
    owners = outline.where("kind = 'paragraph'").select("script_id", F.col("line").alias("owner"), F.concat(F.lit("P"), "digits").alias("of"))
    rows = rows.withColumn("again", again & F.col("problem").isNull()).join(owners, ["script_id", "owner"], "left")
    return rows.withColumn("problem", F.when(F.col("again"), F.format_string("chart '%s' is tagged twice on %s", "id", "of")).otherwise(F.col("problem"))).drop("again", "of")


def pause_tags(outline: DataFrame) -> DataFrame:
    """(script_id, owner, line, seq, pause, problem) of all pause tags."""
    rows = outline.select("script_id", "owner", "line", F.posexplode(F.regexp_extract_all(F.col("text"), F.lit(PAUSE_TAG), F.lit(1))).alias("seq", "content"))
    value = _seconds(F.col("content"))
    problem = _pause_problem(value, F.col("owner"))
    rows = rows.select("script_id", "owner", "line", "seq", value.alias("pause"), problem.alias("problem"))
    good = Window.partitionBy("script_id", "owner", F.col("problem").isNull()).orderBy("line", "seq")
    rows = rows.withColumns({"nth": F.row_number().over(good), "first_line": F.first("line").over(good)})
    owners = outline.where("kind = 'paragraph'").select("script_id", F.col("line").alias("owner"), F.concat(F.lit("P"), "digits").alias("of"))
    twice = F.col("problem").isNull() & (F.col("nth") > 1)
    rows = rows.join(owners, ["script_id", "owner"], "left")
    return rows.withColumn("problem", F.when(twice, F.format_string("%s has two pause tags (first at line %d)", "of", "first_line")).otherwise(F.col("problem"))).drop("nth", "first_line", "of")


def number_problems(outline: DataFrame) -> DataFrame:
    """(script_id, line, message): numbers that are repeated or smaller than the one before."""
    # Numbers of any length: fewer digits come first.
    rows = outline.where("kind = 'paragraph'").select("script_id", "line", "digits", F.struct(F.length("digits").alias("n"), "digits").alias("size"))
    first = F.min("line").over(Window.partitionBy("script_id", "digits"))
    rows = rows.withColumns({"first_line": first, "last": F.lag("size").over(Window.partitionBy("script_id").orderBy("line"))})
    message = F.when(F.col("line") > F.col("first_line"), F.format_string("P%s is repeated (first at line %d)", "digits", "first_line")).when(F.col("size") < F.col("last"), F.format_string("P%s comes after P%s but numbers must increase", "digits", "last.digits"))
    return rows.select("script_id", "line", message.alias("message")).where("message is not null")


def paragraphs(lines: DataFrame, mode: str = QUOTE) -> DataFrame:
    """Paragraphs with text: script_id, chapter_no, chapter, ord, id, number, line, text, charts, pause_after.

    Chapters are counted by place, those without paragraphs left out; equal
    titles stay apart.
    """
    outline = outlined(lines)
    heads = outline.where("kind = 'heading' AND level IN (2, 3)").select("script_id", "chapter_key", chapter_title(F.col("body"), mode).alias("title"))
    tags = chart_tags(outline).where("problem is null").groupBy("script_id", "owner").agg(F.transform(F.sort_array(F.collect_list(F.struct("line", "seq", "id", "sequence"))), lambda t: F.struct(t["id"].alias("id"), t["sequence"].alias("sequence"), t["line"].alias("line"))).alias("charts"))
    pauses = pause_tags(outline).where("problem is null").groupBy("script_id", "owner").agg(F.min("pause").alias("pause_after"))
    texts = _texts(outline, mode).select("script_id", "owner", clean_text(F.col("raw")).alias("text")).where("text <> ''")
    rows = outline.where("kind = 'paragraph'").select("script_id", "chapter_key", "digits", "number", "line", F.col("line").alias("owner"))
    rows = rows.join(texts, ["script_id", "owner"]).join(tags, ["script_id", "owner"], "left").join(pauses, ["script_id", "owner"], "left").join(heads, ["script_id", "chapter_key"], "left")
    order = Window.partitionBy("script_id").orderBy("line")
    none = F.array().cast("array<struct<id:string,sequence:boolean,line:int>>")
    return rows.select(
        "script_id",
        (F.dense_rank().over(Window.partitionBy("script_id").orderBy("chapter_key")) - 1).alias("chapter_no"),
        F.coalesce("title", F.lit(INTRO)).alias("chapter"),
        (F.row_number().over(order) - 1).alias("ord"),
        F.concat(F.lit("P"), "digits").alias("id"),
        "number",
        "line",
        "text",
        F.coalesce(F.col("charts").cast("array<struct<id:string,sequence:boolean,line:int>>"), none).alias("charts"),
        "pause_after",
    )


def problems(lines: DataFrame, mode: str = QUOTE) -> DataFrame:
    """(script_id, line, seq, message) of everything that is wrong with each script.

    Lines are read and dealt by script once. What a line has to say becomes
    events, which are told apart by kind; paragraphs are grouped from these,
    and a script's last paragraph is found among its paragraphs.
    """
    marked = lambda shape: F.when(F.col("text").contains("<!--"), F.regexp_extract_all(F.col("text"), F.lit(shape), F.lit(1)))
    counts = F.col("kind") == "quote" if mode == QUOTE else F.col("kind").isin("paragraph", "text")
    untitled = (F.col("kind") == "heading") & F.col("level").isin(2, 3) & (chapter_title(F.col("body"), mode) == "")
    rows = line_kinds(lines).select("script_id", "line", "kind", "digits", F.when(counts, F.col("body")).alias("body"), untitled.alias("untitled"), marked(CHART_TAG).alias("charts"), marked(PAUSE_TAG).alias("pauses"))
    script = Window.partitionBy("script_id").orderBy("line")
    so_far, before = script.rowsBetween(Window.unboundedPreceding, Window.currentRow), script.rowsBetween(Window.unboundedPreceding, -1)
    is_paragraph = F.col("kind") == "paragraph"
    # Numbers of any length: fewer digits come first.
    size = F.struct(F.length("digits").alias("n"), "digits")
    rows = rows.withColumns(
        {
            "bound": F.last(F.when(F.col("kind").isin("paragraph", "unseparated", "heading"), F.struct("line", "kind", "digits")), ignorenulls=True).over(so_far),
            "stop": F.last(F.when(F.col("kind").isin("blank", "quote"), F.col("line")), ignorenulls=True).over(so_far),
            "last": F.last(F.when(is_paragraph, size), ignorenulls=True).over(before),
            "nth_line": F.row_number().over(script),
            "n": F.count(F.when(is_paragraph, 1)).over(Window.partitionBy("script_id")),
        }
    )
    in_one = F.col("bound.kind") == "paragraph"
    rows = rows.withColumns({"owner": F.when(in_one, F.col("bound.line")), "of": F.when(in_one, F.col("bound.digits"))})
    counted = F.col("body").isNotNull() & F.col("owner").isNotNull()
    if mode == INLINE:
        counted = counted & (F.coalesce(F.col("stop"), F.lit(-1)) < F.col("owner"))

    def event(kind: str, seq: Column, key: Column, problem: Column, value: Column) -> Column:
        text = lambda c, name: c.cast("string").alias(name)
        return F.struct(F.lit(kind).alias("event"), seq.cast("int").alias("seq"), text(key, "key"), text(problem, "problem"), text(value, "value"))

    none = F.lit(None)
    tag = lambda kind, name, read: F.coalesce(F.transform(name, lambda c, k: event(kind, k, *read(c))), F.array().cast(_EVENTS))
    # Charts and pauses are judged as chart_tags and pause_tags judge them.
    charts = tag("chart", "charts", lambda c: (_chart_parts(c)[0], _chart_problem(_chart_parts(c), F.col("owner")), none))
    pauses = tag("pause", "pauses", lambda c: (none, _pause_problem(_seconds(c), F.col("owner")), none))
    fell = F.when(size < F.col("last"), F.format_string("P%s comes after P%s but numbers must increase", "digits", "last.digits"))
    own = F.array(
        F.when(is_paragraph, event("paragraph", F.lit(0), F.col("digits"), none, fell)),
        F.when(F.col("kind") == "unseparated", event("unseparated", F.lit(0), none, F.format_string("P%s is missing a separator after the identifier (use '-', ':', '.', an en dash or an em dash)", "digits"), none)),
        F.when(F.col("untitled"), event("untitled", F.lit(0), none, F.lit("chapter heading has no title"), none)),
        F.when(counted, event("text", F.lit(0), none, none, F.col("body"))),
        F.when((F.col("n") == 0) & (F.col("nth_line") == 1), event("empty", F.lit(0), none, F.lit("no paragraphs found"), none)),
    )
    rows = rows.select("script_id", "owner", "of", "line", F.explode(F.concat(F.array_compact(own), charts, pauses)).alias("e")).select("script_id", "owner", "of", "line", "e.*")

    # Numbers are repeated in a script, charts and pauses in a paragraph.
    inside = F.when(F.col("event").isin("chart", "pause"), F.col("owner"))
    alike = Window.partitionBy("script_id", "event", inside, "key", F.col("problem").isNull()).orderBy("line", "seq")
    rows = rows.withColumns({"nth": F.row_number().over(alike), "first_line": F.first("line").over(alike)})
    good, again = F.col("problem").isNull(), F.col("nth") > 1
    message = (
        F.when((F.col("event") == "paragraph") & (F.col("line") > F.col("first_line")), F.format_string("P%s is repeated (first at line %d)", "key", "first_line"))
        .when(F.col("event") == "paragraph", F.col("value"))
        .when(good & again & (F.col("event") == "chart"), F.format_string("chart '%s' is tagged twice on %s", "key", F.concat(F.lit("P"), "of")))
        .when(good & again & (F.col("event") == "pause"), F.format_string("%s has two pause tags (first at line %d)", F.concat(F.lit("P"), "of"), "first_line"))
        .otherwise(F.col("problem"))
    )
    place = F.create_map(*(F.lit(x) for pair in {"paragraph": 0, "unseparated": 1, "untitled": 1, "chart": 2, "pause": 3, "empty": 5}.items() for x in pair))[F.col("event")]
    said = lambda line, seq, message: F.struct(line.cast("int").alias("line"), seq.cast("int").alias("seq"), message.alias("message"))
    is_text = F.col("event") == "text"
    found = rows.withColumn("message", message).groupBy("script_id", "owner").agg(
        F.max("of").alias("of"),
        F.collect_list(F.when(F.col("message").isNotNull(), said(F.when(F.col("event") != "empty", F.col("line")), place, F.col("message")))).alias("said"),
        F.sort_array(F.collect_list(F.when(is_text, F.struct("line", F.col("value").alias("body"))))).alias("picked"),
        F.min(F.when((F.col("event") == "pause") & F.col("message").isNull(), F.col("line"))).alias("pause_line"),
    )
    text = clean_text(F.array_join(F.transform("picked", lambda x: x["body"]), " "))
    found = found.select("script_id", "owner", F.concat(F.lit("P"), "of").alias("id"), "said", "pause_line", F.size("picked").alias("n"), text.alias("text"))
    found = found.withColumns({"empty": F.when(F.col("n") == 0, "blockquote").when(F.col("text") == "", "text")}).drop("text")
    last = F.max(F.when(F.col("owner").isNotNull() & F.col("empty").isNull(), F.col("owner"))).over(Window.partitionBy("script_id"))
    untold = F.when(F.col("empty") == "blockquote", F.format_string("%s has no blockquote (use --text inline?)", "id")).otherwise(F.format_string("%s has no text to align (empty after cleaning)", "id"))
    more = F.array(
        F.when(F.col("owner").isNotNull() & F.col("empty").isNotNull(), said(F.col("owner"), F.lit(4), untold)),
        F.when((F.col("owner") == F.col("last")) & F.col("pause_line").isNotNull(), said(F.col("pause_line"), F.lit(6), F.format_string("%s is the last paragraph, no paragraph follows its pause", "id"))),
    )
    return found.withColumn("last", last).select("script_id", F.explode(F.concat("said", F.array_compact(more))).alias("p")).select("script_id", "p.*")


def script_words(found: DataFrame, words: Column) -> DataFrame:
    """(script_id, ord, pos, gpos, word): a row a word; gpos counts over the whole script. Paragraphs are counted before they are cut, so no words are dealt."""
    before = Window.partitionBy("script_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = found.select("script_id", "ord", words.alias("ws")).withColumn("before", F.coalesce(F.sum(F.size("ws")).over(before), F.lit(0)).cast("int"))
    return rows.select("script_id", "ord", "before", F.posexplode("ws").alias("pos", "word")).select("script_id", "ord", "pos", (F.col("before") + F.col("pos")).alias("gpos"), "word")
