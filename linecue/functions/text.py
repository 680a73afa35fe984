"""Text to comparable words as expressions: cleaning, folding, marks and spelled-out numbers.

Classes of characters are those of the JVM's Unicode version. `fold` and
`merged_list` do the same inside the Python tasks that need it.
"""

from __future__ import annotations

import unicodedata

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from linecue.functions.unicode import bound, fold_case

# Number words.
UNITS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9}
TEENS = {"ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19}
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
DIGITS = {"zero": "0", "oh": "0", **{word: str(n) for word, n in UNITS.items()}}
_VALUE = UNITS | TEENS | TENS

# Characters that count as an apostrophe.
APOSTROPHES = "'’ʼ"
#: What Python takes for white space.
WHITE = r"[\s\p{Z}\x1c-\x1f\x85]"
_MARKS = regex.compile(
    rf"(?P<apostrophe>(?<=[\p{{L}}\p{{N}}])[{APOSTROPHES}](?=[\p{{L}}\p{{N}}]))"
    r"|(?P<point>(?<=\p{Nd})\.(?=\p{Nd}))"
    r"|(?P<gap>\p{Pd}|/|\s)"
    rf"|(?P<drop>[\p{{P}}\p{{S}}{APOSTROPHES}])"
)
_INSTEAD = {"apostrophe": "'", "point": ".", "gap": " ", "drop": ""}


def _any(words) -> str:
    return f"(?:{'|'.join(words)})(?!\\S)"


# A grammar of cardinals as one expression: atomic groups, as a part that is read is never given back.
_TEN = f"(?:{_any(TENS)}(?: {_any(UNITS)})?|{_any(TEENS)}|{_any(UNITS)})"
_HUNDRED = rf"(?>{_any(UNITS)} hundred(?!\S)(?:(?>(?: and(?!\S))?+ {_TEN})(?! hundred(?!\S)))?|{_TEN})"
_THOUSAND = rf"{_HUNDRED}(?: thousand(?!\S)(?:(?> and(?!\S) {_TEN}| {_HUNDRED})(?! (?:hundred|thousand)(?!\S)))?)?"
NUMBER = rf"(?<!\S)(?>zero(?!\S)|{_THOUSAND})(?: point(?!\S)(?: {_any(DIGITS)})+)?"
_NUMBER = regex.compile(NUMBER)
#: Words that can be part of a number.
NUMBER_WORDS = ("zero", "oh", *_VALUE, "hundred", "thousand", "and", "point")


def fold(text: str) -> list[str]:
    """Words of a text in comparable form, numbers as they are written."""
    return _MARKS.sub(lambda m: _INSTEAD[m.lastgroup], unicodedata.normalize("NFKC", text).casefold()).split()


def _digits(number: str) -> str:
    whole, small = 0, 0
    cardinal, _, fraction = number.partition(" point ")
    for word in cardinal.split():
        if word == "hundred":
            small *= 100
        elif word == "thousand":
            whole, small = small * 1000, 0
        else:
            small += _VALUE.get(word, 0)
    return f"{whole + small}" + ("." + "".join(DIGITS[w] for w in fraction.split()) if fraction else "")


def merged_list(words: list[str]) -> list[tuple[str, int, int]]:
    """merge_numbers inside a task: (word, first, last), first and last telling the words that each came from."""
    line, out, done = " ".join(words), [], 0
    for m in _NUMBER.finditer(line):
        first = line.count(" ", 0, m.start())
        last = first + m[0].count(" ")
        out += [(words[i], i, i) for i in range(done, first)] + [(_digits(m[0]), first, last)]
        done = last + 1
    return out + [(words[i], i, i) for i in range(done, len(words))]


def _looked_up(word: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), word)


def in_digits(number: Column) -> Column:
    """`four hundred two point five` as `402.5`; number: words that NUMBER fits."""
    words = F.split(number, " ")
    point = F.array_position(words, "point").cast("int")
    whole = F.when(point > 0, F.slice(words, F.lit(1), F.greatest(point - 1, F.lit(0)))).otherwise(words)
    start = F.struct(F.lit(0).alias("thousands"), F.lit(0).alias("rest"))
    step = lambda acc, w: (
        F.when(w == "hundred", F.struct(acc["thousands"].alias("thousands"), (acc["rest"] * 100).alias("rest")))
        .when(w == "thousand", F.struct((acc["rest"] * 1000).alias("thousands"), F.lit(0).alias("rest")))
        .otherwise(F.struct(acc["thousands"].alias("thousands"), (acc["rest"] + F.coalesce(_looked_up(w, _VALUE), F.lit(0))).alias("rest")))
    )
    value = F.aggregate(whole, start, step, lambda acc: (acc["thousands"] + acc["rest"]).cast("string"))
    fraction = F.array_join(F.transform(F.slice(words, point + 1, F.size(words)), lambda w: _looked_up(w, DIGITS)), "")
    return F.when(point > 0, F.concat(value, F.lit("."), fraction)).otherwise(value)


def merge_numbers(words: Column) -> Column:
    """array<struct<word, n>>: words with spelled-out numbers in digits, and how many words each came from."""
    # No word has a line break: it marks where numbers begin and end.
    pieces = lambda ws: F.split(F.regexp_replace(F.array_join(ws, " "), NUMBER, "\n$0\n"), "\n")
    kept = lambda p: F.transform(F.filter(F.split(p, " "), lambda w: w != ""), lambda w: F.struct(w.alias("word"), F.lit(1).alias("n")))
    number = lambda p: F.array(F.struct(in_digits(p).alias("word"), F.size(F.split(p, " ")).alias("n")))
    merged = lambda ws: F.flatten(F.transform(pieces(ws), lambda p, i: F.when(i % 2 == 1, number(p)).otherwise(kept(p))))
    as_they_are = lambda ws: F.transform(ws, lambda w: F.struct(w.alias("word"), F.lit(1).alias("n")))
    return bound(words, lambda ws: F.when(F.arrays_overlap(ws, F.array(*map(F.lit, ("zero", *_VALUE)))), merged(ws)).otherwise(as_they_are(ws)))


def normalize_text(text: Column | str) -> Column:
    """Comparable words of a text, numbers in digits; null and punctuation give none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.transform(merge_numbers(fold_text(F.regexp_replace(text, rf"(?={WHITE})(?<=\p{{Nd}}){WHITE}+(?=\.\p{{Nd}})", ""))), lambda x: x["word"])


def fold_text(text: Column) -> Column:
    """Comparable words of each text, numbers as they are written; null gives none.

    Marks are judged where they stand, so one pass drops all that go; what is
    left of apostrophes, points and gaps needs no look at its neighbours. What
    a character is comes before what stands around it, as most are letters.
    """
    kept = rf"(?<=[\p{{L}}\p{{N}}])[{APOSTROPHES}](?=[\p{{L}}\p{{N}}])|(?<=\p{{Nd}})\.(?=\p{{Nd}})|\p{{Pd}}|/"
    bare = F.regexp_replace(fold_case(F.coalesce(text, F.lit(""))), rf"(?s)(?=[\p{{P}}\p{{S}}{APOSTROPHES}])(?!{kept}).", "")
    return F.filter(F.split(F.translate(bare, APOSTROPHES, "'" * len(APOSTROPHES)), rf"[\p{{Pd}}/{WHITE[1:-1]}]+"), lambda w: w != "")


def plain_words(text: Column) -> Column:
    """Lower-case words without punctuation and symbols: the JVM-side form for bulk statistics."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\p{P}\p{S}]", ""), r"\s+"), lambda w: w != "")


def clean_text(text: Column) -> Column:
    """Text without comments, bracketed source marks (link texts stay) and emphasis, spaces collapsed.

    Marks nest; a pass removes the inner ones, so as many passes as brackets
    are open at once reach the end.
    """
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<!--.*?-->", "")
    marks = F.split(F.regexp_replace(body, r"[^\[\]]", ""), "")
    level = lambda acc, c: F.when(c == "[", acc["now"] + 1).when(c == "]", F.greatest(acc["now"] - 1, F.lit(0))).otherwise(acc["now"])
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    depth = F.aggregate(marks, start, lambda acc, c: F.struct(level(acc, c).alias("now"), F.greatest(acc["most"], level(acc, c)).alias("most")), lambda acc: acc["most"])
    bare = F.when(F.instr(body, "[") > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), body, lambda t, _: F.regexp_replace(t, r"\[[^\[\]]*\](?!\()", ""))).otherwise(body)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, "[*_`]", ""), r"(?U)\s+", " "), "^ | $", "")


def natural_key(name: Column) -> Column:
    """Sort key in which digit runs compare as numbers and letters without case."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"\d+|\D+"), F.lit(0))
    bare = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.length(bare(p)).cast("string"), 6, "0"), bare(p))).otherwise(p)), "\x01")


def paragraph_id_in_name(name: Column) -> Column:
    """`P8` of names like `p08_take2.wav`; null where no P with digits stands alone."""
    stem = F.regexp_replace(name, r"(?<=.)\.[^./]*$", "")
    number = F.regexp_extract(stem, r"(?<![A-Za-z0-9])[Pp]0*(\d+)(?!\d)", 1)
    return F.when(number != "", F.concat(F.lit("P"), number.cast("decimal(38,0)").cast("string")))
